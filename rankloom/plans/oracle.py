"""SQL twins of the catalog's queries, in DuckDB's dialect. Written apart from the operators:
shares come from window sums, unique counts from count(DISTINCT), trees from string_agg."""

from __future__ import annotations

from rankloom import fixed_values as fixed
from rankloom.plans import part_rules, stored

COLUMNS = {
    "title": ("part", "p_name"),
    "artist": ("supplier", "s_name"),
    "genre": ("part", "p_name"),
    "year_released": ("orders", "CAST(year(o_orderdate) AS INTEGER)"),
    "chart_year": ("", "CAST(year(l_shipdate) AS INTEGER)"),
    "artist_type": ("supplier nation region", "r_name"),
    "pop": ("", "CAST(l_quantity AS INTEGER)"),
    "bpm": ("part", "p_size"),
    "nrgy": ("", "CAST(round(l_discount * 100) AS INTEGER)"),
    "dnce": ("", "CAST(round(l_tax * 100) AS INTEGER)"),
    "db": ("", "-l_linenumber"),
    "spch": ("", "CAST(round(l_tax * 100) AS INTEGER)"),
    "acous": ("", "CAST(l_quantity AS INTEGER)"),
    "val": ("part", "CAST(round(p_retailprice) AS INTEGER)"),
    "dur": ("", "CAST(floor(l_extendedprice / 100) AS INTEGER)"),
}
JOINS = {
    "orders": "JOIN orders ON l_orderkey = o_orderkey",
    "part": "JOIN part ON l_partkey = p_partkey",
    "supplier": "JOIN supplier ON l_suppkey = s_suppkey",
    "nation": "JOIN nation ON s_nationkey = n_nationkey",
    "region": "JOIN region ON n_regionkey = r_regionkey",
}


def _songs(columns: str) -> str:
    names = columns.split()
    tables = {table for name in names for table in COLUMNS[name][0].split()}
    joins = " ".join(sql for table, sql in JOINS.items() if table in tables)
    chosen = ", ".join(f"{COLUMNS[name][1]} AS {name}" for name in names)
    return f"(SELECT {chosen} FROM lineitem {joins})"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return ", ".join(_text(value) for value in values)


def _group(rules: list[tuple[str, str]], value: str = "genre") -> str:
    cases = " ".join(f"WHEN regexp_matches({value}, {_text(p)}, 'i') THEN {_text(label)}" for p, label in rules)
    return f"CASE {cases} ELSE 'Other' END"


def _place(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position"


def _chart_genres() -> str:
    names = part_rules.fixed_genres()
    return f"(SELECT list_extract([{_list(names)}], CAST(p_partkey % {len(names)} + 1 AS INTEGER)) AS genre FROM part)"


def _sub_group(lists_of: dict = part_rules.PART_LISTS, defaults: dict = part_rules.PART_DEFAULTS) -> str:
    cases = []
    for group, lists in lists_of.items():
        for label, members in lists:
            cases.append(f"WHEN genre_group = {_text(group)} AND genre IN ({_list(members)}) THEN {_text(label)}")
        fallback = defaults[group]
        cases.append(f"WHEN genre_group = {_text(group)} THEN {'genre' if fallback is None else _text(fallback)}")
    return f"CASE {' '.join(cases)} ELSE genre_group END"


def _caption(key: str) -> str:
    parts = [f"{_text(text)} || ' ' || CAST({column} AS VARCHAR)" for text, column in fixed.CAPTIONS[key]]
    return " || ' ' || ".join(parts)


def _short(value: str, width: int) -> str:
    return f"CASE WHEN length({value}) > {width} THEN substr({value}, 1, {width - 3}) || '...' ELSE {value} END"


def _direction(direction: str) -> str:
    return "DESC NULLS LAST" if direction == "top" else "ASC NULLS LAST"


def _top(
    columns: str, entity: str, n: int, direction: str = "top", key: str = "", measure: str = "total_popularity",
    group: str = "", where: str = "true",
) -> str:
    value = "CAST(sum(pop) AS BIGINT)" if measure == "total_popularity" else "count(*)"
    source = f"(SELECT *, {group} AS genre_group FROM {_songs(columns)})" if group else _songs(columns)
    return f"""
WITH g AS (SELECT {entity}, {value} AS {measure} FROM {source} WHERE {where} GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY {measure} {_direction(direction)}, {entity}) AS INTEGER) AS position
      FROM g)
SELECT *, {_caption(key)} AS text FROM r WHERE position <= {n}"""


def _share(
    columns: str, period: str, entity: str, n: int, direction: str = "top", label: str = "", width: int = 15,
    key: str = "", group: str = "", where: str = "true", repeats: bool = True,
) -> str:
    source = f"(SELECT *, {group} AS genre_group FROM {_songs(columns)})" if group else _songs(columns)
    if repeats:
        grouped = (f"SELECT {period}, {entity}, CAST(sum(pop) AS BIGINT) AS total_popularity "
                   f"FROM {source} WHERE {where} GROUP BY ALL")
    else:
        grouped = (f"SELECT DISTINCT {period}, {entity}, CAST(pop AS BIGINT) AS total_popularity "
                   f"FROM {source} WHERE {where}")
    text = f", {_caption(key)} AS text" if key else ""
    return f"""
WITH g AS ({grouped}),
r AS (SELECT *, CAST(sum(total_popularity) OVER (PARTITION BY {period}) AS BIGINT) AS yearly_total_popularity,
        CAST(row_number() OVER (PARTITION BY {period} ORDER BY total_popularity {_direction(direction)}, {entity})
             AS INTEGER) AS rn
      FROM g)
SELECT {period}, {entity}, total_popularity, yearly_total_popularity,
       total_popularity / nullif(yearly_total_popularity, 0) AS prop, rn, {_short(label, width)} AS label{text}
FROM r WHERE rn <= {n}"""


def _count_per_period(period: str, n: int) -> str:
    return f"""
WITH g AS (SELECT {period}, artist, count(*) AS count FROM {_songs(period + " artist")} GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY {period} ORDER BY count DESC, artist) AS INTEGER) AS rn FROM g)
SELECT *, {_short("artist", 15)} AS label FROM r WHERE rn <= {n}"""


def _words(table: str, column: str, cut: bool) -> str:
    text = f"regexp_replace({column}, '(?is)({fixed.TITLE_CUT}).*', '')" if cut else column
    stop = _list([*fixed.ENGLISH_STOP_WORDS, *fixed.TITLE_STOP_WORDS])
    bare = f"regexp_replace(regexp_replace(lower({text}), '[[:punct:]]+', '', 'g'), '[0-9]+', '', 'g')"
    return f"""
SELECT word, count(*) AS freq
FROM (SELECT array_to_string(list_filter(regexp_extract_all(token, '[\\pL\\pN_]+|[^\\pL\\pN_]+'),
                                         lambda part: part NOT IN ({stop})), '') AS word
      FROM (SELECT unnest(string_split_regex(trim({bare}), '\\s+')) AS token FROM {table}))
WHERE length(word) >= 3 GROUP BY word"""


def _genre_table() -> str:
    return f"""
SELECT genre_group, {_sub_group()} AS sub_group, genre, count
FROM (SELECT genre, count(*) AS count, {_group(part_rules.PART_RULES)} AS genre_group
      FROM {_songs("genre")} GROUP BY genre)"""


def _genre_tree() -> str:
    def node(name: str, rest: str) -> str:
        return f"'{{\"name\":' || to_json({name}) || ',{rest} || '}}'"

    leaf = node("genre", "\"size\":' || count")
    branch = node("sub_group", "\"children\":[' || s || ']'")
    stem = node("genre_group", "\"children\":[' || s || ']'")
    return f"""
WITH t AS ({_genre_table()}),
b AS (SELECT genre_group, sub_group, string_agg({leaf}, ',' ORDER BY genre) AS s FROM t GROUP BY ALL),
c AS (SELECT genre_group, string_agg({branch}, ',' ORDER BY sub_group) AS s FROM b GROUP BY ALL)
SELECT '{{"name":"Genres","children":[' || string_agg({stem}, ',' ORDER BY genre_group) || ']}}' AS json FROM c"""


def _long(columns: str, features: list[str], extra: str = "") -> str:
    source = _songs(columns)
    return " UNION ALL ".join(
        f"SELECT {_text(f)} AS feature, {f} AS value{extra} FROM {source}" for f in features
    )


def _binned(long: str, widths: dict[str, int], extra: str = "") -> str:
    cases = " ".join(f"WHEN {_text(f)} THEN {w}" for f, w in widths.items())
    return f"""
SELECT feature, value{extra}, w, CAST(ceil((value - w / 2.0) / w) AS BIGINT) * w AS bin
FROM (SELECT *, CASE feature {cases} END AS w FROM ({long}))"""


def _histogram(long: str, widths: dict[str, int]) -> str:
    """Every bin from the one of the least value on, counted by comparing values with its two edges."""
    return f"""
WITH v AS ({_binned(long, widths)}),
e AS (SELECT feature, w, min(value) AS least, max(bin) AS last, floor((min(value) - w / 2.0) / w) * w + w / 2.0 AS origin
      FROM v GROUP BY feature, w),
b AS (SELECT feature, w, least, unnest(range(CAST(origin + w / 2.0 AS BIGINT),
                                            greatest(last, CAST(origin + w / 2.0 AS BIGINT)) + 1, w)) AS bin FROM e)
SELECT b.feature, b.bin, count(v.value) AS count
FROM b LEFT JOIN v ON v.feature = b.feature AND v.value <= b.bin + b.w / 2.0
     AND (v.value > b.bin - b.w / 2.0 OR (v.value = b.least AND b.least = b.bin - b.w / 2.0))
GROUP BY b.feature, b.bin"""


def _fixes(value: str) -> str:
    cases = " ".join(f"WHEN {_text(title)} THEN {year}" for title, year in part_rules.TITLE_FIXES.items())
    return f"CASE title {cases} ELSE {value} END"


def _wrapped(value: str) -> str:
    line = "list_extract(string_split(a, chr(10)), -1)"
    return (f"list_reduce(string_split({value}, ' '), lambda a, w: a || CASE WHEN length({line}) + length(w) + 1 < 15 "
            f"THEN ' ' ELSE chr(10) END || w)")


def sql() -> dict[str, str]:
    widths = {name: width for name, width, _, _ in fixed.FEATURES}
    features = list(widths)
    feature_columns = " ".join(features)
    chart_columns = " ".join(name for _, name, _ in fixed.CHART_COLUMNS)
    rules, short_rules = part_rules.PART_RULES, part_rules.PART_RULES_SHORT
    part_words = "p_type || ' ' || p_name || ' ' || p_brand"

    found = {
        "clean_songs": f"""
SELECT title, artist, genre, CAST({_fixes("year_released")} AS INTEGER) AS year_released, chart_year, artist_type, pop
FROM {_songs("title artist genre year_released chart_year artist_type pop")}
WHERE artist_type <> 'AFRICA' AND genre <> 'hot gear' AND year_released <> 1998""",
        "corrected_by_table": f"""
SELECT title, CAST(coalesce(fixed, year_released) AS INTEGER) AS year_released,
       CAST(sum(pop) AS BIGINT) AS total_popularity
FROM {_songs("title year_released pop")}
LEFT JOIN (SELECT p_name, min(p_size) + 2000 AS fixed FROM part GROUP BY p_name HAVING max(p_size) = 50)
     ON title = p_name
GROUP BY ALL""",
        "distinct_songs": f"SELECT DISTINCT * FROM {_songs('title artist artist_type year_released pop')}",
        "distinct_song_scores": f"SELECT DISTINCT * FROM {_songs('year_released title artist pop')}",
        "distinct_type_artists": f"SELECT DISTINCT * FROM {_songs('artist_type artist')}",
        "distinct_year_type_artists": f"SELECT DISTINCT * FROM {_songs('year_released artist_type artist')}",
        "csv_scan": f"SELECT * FROM {_songs(chart_columns)} WHERE artist_type <> 'EUROPE' AND year_released <> 1997",
        "csv_export": _genre_table(),
        "table_export": f"""
SELECT artist_type, artist, CAST(sum(pop) AS BIGINT) AS total_popularity, chart_year
FROM {_songs("chart_year artist artist_type pop")} GROUP BY ALL""",
        "json_export": _genre_tree(),
        "table_search": """
SELECT p_partkey, p_name, p_brand, p_type
FROM (SELECT *, lower(p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type) AS s FROM part)
WHERE contains(s, 'ring') AND contains(s, 'brand#1') AND contains(s, 'eco')""",
        "table_sort": "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey DESC",
        "table_page": f"""
SELECT c_custkey, c_name, c_mktsegment, {_place("c_mktsegment, c_custkey DESC")} FROM customer
ORDER BY c_mktsegment, c_custkey DESC LIMIT 10 OFFSET 20""",
        "table_page_after": f"""
SELECT c_custkey, c_name, c_mktsegment, {_place("c_mktsegment, c_custkey DESC")} FROM customer
WHERE c_mktsegment > 'BUILDING' OR (c_mktsegment = 'BUILDING' AND c_custkey < 100)
ORDER BY c_mktsegment, c_custkey DESC LIMIT 10""",
        "year_table": f"""
SELECT *, {_place("count DESC, year_released")}
FROM (SELECT year_released, count(*) AS count FROM {_songs("year_released")} GROUP BY ALL)
ORDER BY count DESC, year_released LIMIT 11""",
        "title_word_table": f"""
SELECT *, {_place("freq DESC, word")}
FROM ({_words(_songs("title"), "title", True)}) WHERE contains(word || ' ' || freq, 'r')
ORDER BY freq DESC, word LIMIT 10""",
        "genre_groupings": f"""
SELECT *, {_place("count DESC, genre")} FROM ({_genre_table()})
WHERE contains(lower(genre_group || ' ' || sub_group || ' ' || genre || ' ' || count), 'o')
ORDER BY count DESC, genre LIMIT 7 OFFSET 7""",
        "classified_parts": f"""
SELECT p_partkey, genre, genre_group, short_group, {_sub_group()} AS sub_group
FROM (SELECT p_partkey, p_name AS genre, {_group(rules, "p_name")} AS genre_group,
             {_group(short_rules, "p_name")} AS short_group FROM part)""",
        "documents_by_group": f"""
SELECT lang, {_group(fixed.GROUP_RULES_10, "text")} AS genre_group, count(*) AS count FROM documents GROUP BY ALL""",
        "genre_table": _genre_table(),
        "distinct_genre_rows": f"SELECT DISTINCT genre_group, sub_group, genre FROM ({_genre_table()})",
        "genre_table_page": f"""
SELECT *, {_place("genre_group, sub_group, genre")} FROM ({_genre_table()})
ORDER BY genre_group, sub_group, genre LIMIT 7 OFFSET 7""",
        "genre_lines": f"""
SELECT '{{"path":["Genres",' || to_json(genre_group) || ',' || to_json(sub_group) || '],"name":' || to_json(genre)
       || ',"size":' || count || '}}' AS json FROM ({_genre_table()})""",
        "chart_genre_table": f"""
SELECT genre_group, {_sub_group(fixed.SUB_GROUPS, fixed.SUB_GROUP_DEFAULTS)} AS sub_group, genre, count
FROM (SELECT genre, count(*) AS count, {_group(fixed.GROUP_RULES_10)} AS genre_group FROM {_chart_genres()} GROUP BY genre)""",
        "chart_genre_groups": f"""
SELECT genre, count(*) AS count, {_group(fixed.GROUP_RULES_9)} AS genre_group FROM {_chart_genres()} GROUP BY genre""",
        "largest_parts_with_ties": """
WITH g AS (SELECT p_partkey, CAST(sum(nullif(p_size, 7)) AS BIGINT) AS total_popularity FROM part GROUP BY p_partkey),
r AS (SELECT *, rank() OVER (ORDER BY total_popularity DESC NULLS LAST) AS rk FROM g)
SELECT p_partkey, total_popularity FROM r WHERE rk <= 5""",
        "genre_nodes": f"""
SELECT genre_group, sub_group, genre, CAST(sum(count) AS BIGINT) AS size,
       CAST(3 - grouping(genre_group) - grouping(sub_group) - grouping(genre) AS INTEGER) AS level
FROM ({_genre_table()}) GROUP BY ROLLUP (genre_group, sub_group, genre)""",
        "genre_tree": _genre_tree(),
        "songs_per_release_year": f"""
SELECT *, {_caption("year_count")} AS text
FROM (SELECT year_released, count(*) AS count FROM {_songs("year_released")} GROUP BY ALL)""",
        "songs_per_genre_in_group": f"""
SELECT genre, count(*) AS count, {_group(rules)} AS genre_group FROM {_songs("genre")} GROUP BY genre""",
        "songs_per_year_and_group": f"""
SELECT *, {_caption("genre_group_count")} AS text
FROM (SELECT year_released, {_group(rules)} AS genre_group, count(*) AS count
      FROM {_songs("year_released genre")} GROUP BY ALL)""",
        "unique_artists_by_type": f"""
SELECT *, {_place("count DESC, artist_type")}
FROM (SELECT artist_type, count(DISTINCT artist) AS count FROM {_songs("artist_type artist")} GROUP BY ALL)""",
        "unique_artists_by_type_and_year": f"""
SELECT *, {_caption("type_artists_year")} AS text
FROM (SELECT year_released, artist_type, count(DISTINCT artist) AS count
      FROM {_songs("year_released artist_type artist")} GROUP BY ALL)""",
        "songs_by_type": f"""
SELECT *, {_caption("type_songs")} AS text, {_place("count DESC, artist_type")}
FROM (SELECT artist_type, count(*) AS count FROM {_songs("artist_type")} GROUP BY ALL)""",
        "songs_by_type_and_year": f"""
SELECT *, {_caption("type_songs_year")} AS text
FROM (SELECT year_released, artist_type, count(*) AS count FROM {_songs("year_released artist_type")} GROUP BY ALL)""",
        "popularity_by_type": f"""
SELECT *, {_caption("type")} AS text, {_place("total_popularity DESC, artist_type")}
FROM (SELECT artist_type, CAST(sum(pop) AS BIGINT) AS total_popularity FROM {_songs("artist_type pop")} GROUP BY ALL)""",
        "popularity_by_type_and_release_year": f"""
SELECT *, {_caption("type_release_year")} AS text
FROM (SELECT year_released, artist_type, CAST(sum(pop) AS BIGINT) AS total_popularity
      FROM {_songs("year_released artist_type pop")} GROUP BY ALL)""",
        "popularity_by_type_and_chart_year": f"""
SELECT *, {_caption("type_chart_year")} AS text
FROM (SELECT chart_year, artist_type, CAST(sum(pop) AS BIGINT) AS total_popularity
      FROM {_songs("chart_year artist_type pop")} GROUP BY ALL)""",
        "popularity_per_release_year": f"""
SELECT year_released, CAST(sum(pop) AS BIGINT) AS yearly_total_popularity
FROM {_songs("year_released pop")} GROUP BY ALL""",
        "column_ranges": " UNION ALL ".join(
            f'SELECT {_text(name)} AS "column", min({name}) AS min, max({name}) AS max '
            f"FROM {_songs('year_released chart_year pop')}"
            for name in ("year_released", "chart_year", "pop")
        ),
        "events_by_type_and_day": """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS count FROM events GROUP BY ALL""",
        "event_users_by_type_and_day": """
SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT user_id) AS count FROM events GROUP BY ALL""",
        "top_genres_in_group_with_ties": f"""
WITH g AS (SELECT genre, CAST(sum(pop) AS BIGINT) AS total_popularity FROM {_songs("genre pop")}
           WHERE {_group(rules)} = 'Colour' GROUP BY genre),
r AS (SELECT *, rank() OVER (ORDER BY total_popularity DESC) AS rk FROM g)
SELECT genre, total_popularity, {_wrapped("genre")} AS label, {_caption("genre_in_group")} AS text
FROM r WHERE rk <= 3""",
        "top_artists_by_song_count": _top("artist", "artist", 3, key="artist_count", measure="count"),
        "top_artists_by_songs_released": _count_per_period("year_released", 3),
        "top_artists_by_songs_charted": _count_per_period("chart_year", 3),
        "stacked_shares": f"""
WITH s AS (SELECT year_released, genre, total_popularity FROM (
    {_share("year_released genre pop", "year_released", "genre", 5, label="genre")})),
c AS (SELECT *, CAST(sum(total_popularity) OVER (PARTITION BY year_released ORDER BY genre
                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_end FROM s)
SELECT year_released, genre, total_popularity, seg_end - total_popularity AS seg_start,
       seg_end - total_popularity / 2 AS seg_mid FROM c""",
        "part_labels": f"""
SELECT p_partkey, {_short("w", 15)} AS label_15, {_short("w", 13)} AS label_13, {_wrapped("w")} AS wrapped
FROM (SELECT p_partkey, {part_words} AS w FROM part)""",
        "title_words": _words(_songs("title"), "title", True),
        "document_words": _words("documents", "text", False),
        "document_words_cut": _words("documents", "text", True),
        "conversation_words": _words("conversations", "text", False),
        "word_search_page": f"""
SELECT *, {_place("freq DESC, word")} FROM ({_words("documents", "text", False)}) WHERE contains(word, 'th')
ORDER BY freq DESC, word LIMIT 10 OFFSET 10""",
        "feature_histograms": _histogram(_long(feature_columns, features), widths),
        "feature_histograms_plain": f"""
SELECT feature, bin, count(*) AS count FROM ({_binned(_long(feature_columns, features), widths)})
GROUP BY feature, bin""",
        "price_histogram": _histogram(
            "SELECT 'o_totalprice' AS feature, o_totalprice AS value FROM orders", {"o_totalprice": 500}
        ),
        "feature_points": _long(f"{feature_columns} pop", features, ", pop"),
        "feature_points_shown": f"""
SELECT *, CASE feature WHEN 'bpm' THEN 'BPM:  ' || value || ' <br>Popularity:  ' || pop
                       ELSE 'Loudness:  ' || value || ' <br>Popularity  ' || pop END AS text
FROM ({_long("bpm db pop", ["bpm", "db"], ", pop")})""",
        "feature_points_binned": f"""
SELECT feature, bin, count(*) AS count, avg(pop) AS avg_pop
FROM ({_binned(_long(f"{feature_columns} pop", features, ", pop"), widths, ", pop")}) GROUP BY feature, bin""",
    }
    for d in ("top", "bottom"):
        songs = _songs("title artist artist_type year_released pop")
        found[f"{d}_songs"] = f"""
WITH g AS (SELECT DISTINCT * FROM {songs}),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY pop {_direction(d)}, title, artist, year_released, artist_type)
                     AS INTEGER) AS position FROM g)
SELECT *, title || ' by ' || artist AS unique_title, {_caption("song")} AS text FROM r WHERE position <= 10"""
        found[f"{d}_genres"] = _top("genre pop", "genre", 5, d, "genre")
        found[f"{d}_genre_groups"] = _top("genre pop", "genre_group", 3, d, "genre_group", group=_group(rules))
        found[f"{d}_artists"] = _top("artist pop", "artist", 5, d, "artist")
        found[f"{d}_artists_of_type"] = _top(
            "artist artist_type pop", "artist", 3, d, "artist", where="artist_type = 'EUROPE'"
        )
        share = f"share_{d}_"
        for period, frame in (("year_released", "release_year"), ("chart_year", "chart_year")):
            found[f"{share}songs_by_{frame}"] = _share(
                f"{period} title artist pop", period, "title, artist", 3, d, "title", 15, f"song_{frame}",
                repeats=period == "chart_year",
            )
            found[f"{share}genres_by_{frame}"] = _share(
                f"{period} genre pop", period, "genre", 3, d, "genre", 15, f"genre_{frame}"
            )
            found[f"{share}genre_groups_by_{frame}"] = _share(
                f"{period} genre pop", period, "genre_group", 4, d, "genre_group", 13, f"genre_group_{frame}",
                group=_group(rules),
            )
            found[f"{share}artists_by_{frame}"] = _share(
                f"{period} artist pop", period, "artist", 5, d, "artist", 15, f"artist_{frame}"
            )
            found[f"{share}artists_of_type_by_{frame}"] = _share(
                f"{period} artist artist_type pop", period, "artist", 3, d, "artist", 15,
                where="artist_type = 'ASIA'",
            )
            found[f"share_top_genres_in_group_by_{frame}"] = _share(
                f"{period} genre pop", period, "genre", 3, "top", "genre", 13, f"genre_in_group_{frame}",
                group=_group(rules), where="genre_group = 'Colour'",
            )
        both = "year_released chart_year genre pop"
        found[f"{share}genres_by_release_and_chart_year"] = _share(
            both, "year_released", "genre, chart_year", 3, d, "genre", 15, "genre_release_year_by_chart_year"
        )
        found[f"{share}genres_by_chart_and_release_year"] = _share(
            both, "chart_year", "genre, year_released", 3, d, "genre", 15, "genre_chart_year_by_release_year"
        )
    return found | _stored()


def _tree_lines() -> str:
    """Each genre's line from the names before and after it."""
    opened = lambda name: f"'{{\"name\":' || to_json({name}) || ',\"children\":['"
    return f"""
WITH t AS (SELECT *, row_number() OVER w AS position, lag(genre_group) OVER w AS bg, lag(sub_group) OVER w AS bs,
                  lead(genre_group) OVER w AS ag, lead(sub_group) OVER w AS sa
           FROM ({_genre_table()}) WINDOW w AS (ORDER BY genre_group, sub_group, genre))
SELECT position, CASE WHEN bg IS NULL THEN '' ELSE ',' END
       || CASE WHEN bg IS DISTINCT FROM genre_group THEN {opened("genre_group")} ELSE '' END
       || CASE WHEN bg IS DISTINCT FROM genre_group OR bs <> sub_group THEN {opened("sub_group")} ELSE '' END
       || '{{"name":' || to_json(genre) || ',"size":' || count || '}}'
       || CASE WHEN ag IS DISTINCT FROM genre_group OR sa <> sub_group THEN ']}}' ELSE '' END
       || CASE WHEN ag IS DISTINCT FROM genre_group THEN ']}}' ELSE '' END AS line FROM t
UNION ALL SELECT 0, {opened("'Genres'")}
UNION ALL SELECT 9223372036854775807, ']}}'"""


def _stored() -> dict[str, str]:
    shares = []
    for question, (period, entity) in stored.QUESTIONS.items():
        found = _share(f"{period} {entity[0]} pop", period, entity[0], 3, label=entity[0])
        shares.append(
            f"SELECT {_text(question)} AS question, {period} AS period, {entity[0]} AS entity, total_popularity, prop, rn "
            f"FROM ({found})"
        )
    chart_columns = [name for _, name, _ in fixed.CHART_COLUMNS]
    mixed = ", ".join("CASE WHEN year_released >= 1998 THEN db END AS db" if name == "db" else name for name in chart_columns)
    return {
        "table_page_far": f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS position
FROM lineitem QUALIFY position BETWEEN 4991 AND 5000""",
        "table_positions": """
SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey DESC) AS position FROM customer""",
        "table_search_indexed": """
SELECT p_partkey, p_name, p_brand, p_type
FROM (SELECT *, lower(p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type) AS s FROM part)
WHERE contains(s, 'ring') AND contains(s, 'brand#1') AND contains(s, 'eco')""",
        "document_search_indexed": """
SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'caci') AND contains(lower(text), 'tion')""",
        "parts_by_rule_table": f"""
SELECT p_partkey, p_name AS genre, {_group(part_rules.PART_RULES, "p_name")} AS genre_group FROM part""",
        "documents_by_item_rules": """
WITH r AS (SELECT item_id, lower(string_split(text, ' ')[-1]) AS word FROM benchmark),
f AS (SELECT doc_id, min(item_id) AS item_id FROM documents JOIN r ON contains(lower(text), word) GROUP BY doc_id)
SELECT doc_id, coalesce('item ' || item_id, 'none') AS item FROM documents LEFT JOIN f USING (doc_id)""",
        "artists_in_span": f"""
SELECT artist_type, count(DISTINCT artist) AS count FROM {_songs("year_released artist_type artist")}
WHERE year_released BETWEEN 1996 AND 1998 GROUP BY artist_type""",
        "artists_in_any_year": f"SELECT count(DISTINCT artist) AS count FROM {_songs('artist')}",
        "artists_kept_up": f"""
SELECT artist_type, count(DISTINCT artist) AS count FROM {_songs("artist_type artist")} GROUP BY artist_type""",
        "title_words_in_order": f"""
SELECT *, row_number() OVER (ORDER BY freq DESC, word) AS position FROM ({_words(_songs("title"), "title", True)})""",
        "genre_table_in_order": f"""
SELECT *, row_number() OVER (ORDER BY genre_group, sub_group, genre) AS position FROM ({_genre_table()})""",
        "songs_kept_up": f"""
SELECT year_released, artist_type, count(*) AS count, CAST(sum(pop) AS BIGINT) AS total_popularity
FROM {_songs("year_released artist_type pop")} GROUP BY ALL""",
        "genre_tree_lines": _tree_lines(),
        "stacked_lines": """
WITH s AS (SELECT l_linenumber, l_orderkey, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
c AS (SELECT *, CAST(sum(quantity) OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, quantity
                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_end FROM s)
SELECT l_linenumber, l_orderkey, quantity, seg_end - quantity AS seg_start, seg_end - quantity / 2 AS seg_mid FROM c""",
        "six_shares": " UNION ALL ".join(shares),
        "csv_mixed_scan": f"SELECT {mixed} FROM {_songs(' '.join(chart_columns))}",
    }
