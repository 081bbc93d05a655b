"""Twelve chart rows, each there for a reason, with hand-checked answers in test_golden.py."""

from __future__ import annotations

HEADER = "title,artist,top genre,year released,top year,artist type,pop,bpm"
ROWS = """
Gold,Ann,pop rap,1999,2015,Solo,70,100
Gold,Ann,pop rap,2015,2016,Solo,70,100
Without You,Bea,dance pop,2011,2011,Solo,60,95
Defeat the Night,Cy & Di,trap music,2011,2011,Duo,60,96
Hey (feat. Bea),Cy & Di,trap music,2011,2012,Duo,40,105
Don't Stop,Eel Band,boy band,2011,2011,Band/Group,60,115
Blue Night,Fay Trio,jazz blues,2012,2012,Trio,55,116
Night Night,Eel Band,permanent wave,2012,2012,Band/Group,0,85
Old One,Gus,rock,1975,2012,Solo,50,120
No Year,Gus,rock,,2012,Solo,50,120
,Hal,indietronica,2012,2012,Solo,33,94
Easier,Ivy,tropical house,2001,2019,Solo,80,126
""".strip().split("\n")

COLUMNS = [
    ("title", "title", "string"),
    ("artist", "artist", "string"),
    ("top genre", "genre", "string"),
    ("year released", "year_released", "int"),
    ("top year", "chart_year", "int"),
    ("artist type", "artist_type", "string"),
    ("pop", "pop", "int"),
    ("bpm", "bpm", "int"),
]


def write(folder, rows=ROWS) -> str:
    path = folder / "songs.csv"
    path.write_text("\n".join([HEADER, *rows]) + "\n", encoding="utf-8")
    return str(path)
