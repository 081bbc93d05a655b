"""Rule tables for the test tables' own categories, with an overlap and a dead rule on purpose."""

from rankloom import fixed_values as fixed

# "old" also catches "cold", so the second rule never applies.
PART_RULES = [
    ("old", "Aged"),
    ("cold", "Cold"),
    ("red|blue", "Colour"),
    ("large|small", "Size"),
    ("anvil|bolt", "Hardware"),
]
PART_RULES_SHORT = [rule for rule in PART_RULES if rule[1] != "Hardware"]

PART_LISTS = {
    "Colour": [
        ("Round", ["red ring", "blue ring", "red gear", "blue gear"]),
        ("Long", ["red rod", "blue rod", "red ring"]),
    ],
    "Size": [("Big", ["large anvil", "large plate", "large gear"])],
    "Other": [("Warm", ["hot rod", "hot plate", "hot ring"]), ("Fresh", ["new ring", "new rod", "hot rod"])],
}
PART_DEFAULTS = {"Colour": "Other Colour", "Size": "Other Size", "Other": None}

TITLE_FIXES = {"red ring": 2015, "old anvil": 1990, "large gizmo": 2003, "not a title": 1980}


def fixed_genres() -> list[str]:
    """The genres that the fixed lists name, and a name made of each group rule's pattern."""
    listed = [name for lists in fixed.SUB_GROUPS.values() for _, members in lists for name in members]
    ruled = [f"my {pattern.split('|')[0]} tune" for pattern, _ in fixed.GROUP_RULES_10]
    return [*dict.fromkeys([*listed, *ruled, "yodel"])]
