"""Rule tables, word lists and label texts that results depend on.

They are data, kept in the order in which they apply. The first matching rule or list wins.
"""

# Corrected release years, by exact title.
CORRECTIONS = {
    "Read All About It": 2011,
    "Hurts So Good": 2016,
    "Eenie Meenie": 2010,
    "We No Speak Americano (Edit)": 2010,
    "Gold": 2015,
    "Easier": 2019,
    "i'm so tired...": 2019,
    "Options": 2018,
    "I Follow Rivers - The Magician Remix": 2011,
}

# Release years left out when the table is cleaned.
DROPPED_YEARS = (1975,)

# Genre -> genre group: case-insensitive patterns, matched anywhere in the genre.
DEFAULT_GROUP = "Other"
GROUP_RULES_10 = [
    ("pop", "Pop"),
    ("hip hop|rap", "Hip Hop/Rap"),
    ("rock|metal", "Rock"),
    ("edm|dance|house|electronic", "Electronic/Dance"),
    ("r&b|soul|funk", "R&B/Soul"),
    ("latin|reggaeton", "Latin"),
    ("country", "Country"),
    ("folk|americana", "Folk"),
    ("jazz|blues", "Jazz/Blues"),
]
# The nine-label set, used by the popularity rankings: the same without Jazz/Blues.
GROUP_RULES_9 = [rule for rule in GROUP_RULES_10 if rule[1] != "Jazz/Blues"]

# Genre -> sub-group, by genre group. A group that is not listed is its own only sub-group.
SUB_GROUPS = {
    "Pop": [
        ("Modern Pop", ["dance pop", "electropop", "synthpop", "pop soul", "pop rock", "pop rap", "indie pop",
                        "art pop", "baroque pop", "chamber pop", "pop punk"]),
        ("Teen Pop", ["teen pop", "boy band", "bubblegum pop", "folk-pop", "social media pop", "candy pop",
                      "bedroom pop", "poptimism"]),
        ("Regional Pop", ["pop", "alternative pop", "canadian pop", "barbadian pop", "australian pop", "irish pop",
                          "belgian pop", "german pop", "chill pop", "native american pop", "french indie pop",
                          "metropopolis"]),
    ],
    "Hip Hop/Rap": [
        ("Southern Hip Hop", ["atl hip hop", "southern hip hop", "dirty south rap", "florida rap", "dfw rap"]),
        ("East Coast Hip Hop", ["east coast hip hop", "gangster rap", "new jersey rap", "new york hip hop",
                                "philadelphia rap"]),
        ("West Coast Hip Hop", ["west coast hip hop", "cali rap", "san diego rap"]),
        ("Midwest Hip Hop", ["chicago rap", "detroit hip hop", "ohio hip hop"]),
        ("Mainstream Hip Hop", ["hip hop", "conscious hip hop", "alternative hip hop", "melodic rap", "trap music",
                                "emo rap"]),
        ("International Hip Hop", ["canadian hip hop", "asian american hip hop", "uk hip hop", "dutch hip hop"]),
    ],
    "Other": [
        ("Indie/Alternative", ["australian indie", "icelandic indie", "electro", "aussietronica", "australian psych",
                               "la indie", "indietronica", "irish singer-songwriter", "neo mellow"]),
        ("Electronic", ["big room", "brostep", "complextro", "destroy techno", "downtempo", "eau claire indie",
                        "french shoegaze", "new french touch", "indietronica"]),
        ("Pop Variants", ["adult standards", "alt z", "comic", "emo", "hollywood", "idol", "lilith",
                          "permanent wave", "talent show"]),
        ("Fusion/World", ["afrofuturism", "afroswing", "reggae fusion"]),
        ("Other", ["basshall", "grime", "uk drill"]),
    ],
}
# Sub-group of a genre that is in none of its group's lists. None: the genre itself.
SUB_GROUP_DEFAULTS = {"Pop": "Other Pop", "Hip Hop/Rap": "Other Hip Hop", "Other": None}

# Audio features: column, histogram bin width, and the two texts of a feature/popularity point.
FEATURES = [
    ("bpm", 10, "BPM: ", "<br>Popularity: "),
    ("nrgy", 10, "Energy: ", "<br>Popularity: "),
    ("dnce", 10, "Danceability: ", "<br>Popularity: "),
    ("db", 1, "Loudness: ", "<br>Popularity "),
    ("spch", 1, "Speechiness: ", "<br>Popularity: "),
    ("acous", 10, "Acousticness: ", "<br>Popularity: "),
    ("val", 10, "Valence: ", "<br>Popularity: "),
    ("dur", 10, "Duration: ", "<br>Popularity: "),
]

# CSV header -> column name and type.
CHART_COLUMNS = [
    ("title", "title", "string"),
    ("artist", "artist", "string"),
    ("top genre", "genre", "string"),
    ("year released", "year_released", "int"),
    ("top year", "chart_year", "int"),
    ("artist type", "artist_type", "string"),
    ("pop", "pop", "int"),
    ("bpm", "bpm", "int"),
    ("nrgy", "nrgy", "int"),
    ("dnce", "dnce", "int"),
    ("dB", "db", "int"),
    ("spch", "spch", "int"),
    ("acous", "acous", "int"),
    ("val", "val", "int"),
    ("dur", "dur", "int"),
]

# Time frames: accepted names (lower case) -> our name.
FRAMES = {
    "all time": "all_time",
    "release years": "release_years",
    "each year": "chart_years",
    "release years + top years": "release_years_by_chart_year",
    "each year + release year": "chart_years_by_release_year",
}

# Rows per page of the three result tables.
PAGE_LENGTHS = {"years": 11, "words": 10, "genres": 7}

# Where a title is cut for the word counts, and words that never count there.
TITLE_CUT = "feat|with"
TITLE_STOP_WORDS = ["radio", "remix", "edit"]

# Common English words (the Snowball stop-word list).
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing would should could ought i'm you're he's she's it's we're they're
i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't
wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't
mustn't let's that's who's what's here's there's when's where's why's how's a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very
""".split()

# Texts shown with a result row: (text, column) pairs, joined by single spaces.
CAPTIONS = {
    "year_count": [("Year: ", "year_released"), ("<br>Count: ", "count")],
    "song": [("Song: ", "title"), ("<br>Artist: ", "artist"), ("<br>Popularity: ", "pop")],
    "song_release_year": [("Song:", "title"), ("<br>Artist:", "artist"), ("<br>Popularity:", "total_popularity"),
                          ("<br>Release Year:", "year_released")],
    "song_chart_year": [("Song:", "title"), ("<br>Artist:", "artist"), ("<br>Popularity:", "total_popularity"),
                        ("<br>Year:", "chart_year")],
    "genre": [("Genre: ", "genre"), ("<br>Popularity Score: ", "total_popularity")],
    "genre_release_year": [("Genre:", "genre"), ("<br>Popularity:", "total_popularity"),
                           ("<br>Year:", "year_released")],
    "genre_release_year_by_chart_year": [("Genre:", "genre"), ("<br>Popularity:", "total_popularity"),
                                         ("<br>Release Year:", "year_released"), ("<br>Top Year:", "chart_year")],
    "genre_chart_year": [("Genre:", "genre"), ("<br>Popularity:", "total_popularity"),
                         ("<br>Top Year:", "chart_year")],
    "genre_chart_year_by_release_year": [("Genre:", "genre"), ("<br>Popularity:", "total_popularity"),
                                         ("<br>Released Year:", "year_released"), ("<br>Top Year:", "chart_year")],
    "genre_group": [("Genre group:", "genre_group"), ("<br>Popularity score:", "total_popularity")],
    "genre_group_release_year": [("Genre Group:", "genre_group"), ("<br>Popularity:", "total_popularity"),
                                 ("<br>Year:", "year_released")],
    "genre_group_chart_year": [("Genre Group:", "genre_group"), ("<br>Popularity:", "total_popularity"),
                               ("<br>Year:", "chart_year")],
    "genre_group_count": [("Year:", "year_released"), ("<br> Songs:", "count"), ("<br> Genre Group:", "genre_group")],
    "genre_in_group": [("Genre:", "genre"), ("<br>Popularity:", "total_popularity")],
    "genre_in_group_release_year": [("Genre:", "genre"), ("<br>Popularity:", "total_popularity"),
                                    ("<br>Year:", "year_released")],
    "genre_in_group_chart_year": [("Genre:", "genre"), ("<br>Popularity:", "total_popularity"),
                                  ("<br>Year:", "chart_year")],
    "artist": [("Artist:", "artist"), ("<br>Total Popularity:", "total_popularity")],
    "artist_release_year": [("Artist:", "artist"), ("<br>Popularity:", "total_popularity"),
                            ("<br>Year:", "year_released")],
    "artist_chart_year": [("Artist:", "artist"), ("<br>Popularity:", "total_popularity"), ("<br>Year:", "chart_year")],
    "artist_count": [("Artist:", "artist"), ("<br>Number of Songs:", "count")],
    "type_songs": [("Artist Type: ", "artist_type"), ("<br>Count: ", "count")],
    "type_artists_year": [("Year:", "year_released"), ("<br>Artists:", "count"), ("<br>Artist Type:", "artist_type")],
    "type_songs_year": [("Year:", "year_released"), ("<br>Songs:", "count"), ("<br>Artist Type:", "artist_type")],
    "type": [("Artist Type:", "artist_type"), ("<br>Total Popularity:", "total_popularity")],
    "type_release_year": [("Release Year:", "year_released"), ("<br> Popularity:", "total_popularity"),
                          ("<br> Artist Type:", "artist_type")],
    "type_chart_year": [("Top Year:", "chart_year"), ("<br> Popularity:", "total_popularity"),
                        ("<br> Artist Type:", "artist_type")],
}
