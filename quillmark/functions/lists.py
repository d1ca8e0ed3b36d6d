"""Word lists and limits of the corpus model."""

# Function words that carry no content of their own.
STOPLIST = frozenset("""
the and of a to in that he shall unto for his they be is him with not it
them all which i ye thou thy thee was have from but as this their we you
are my me upon by said one at out so
your our us her she there then when if on into up an or no who what also
were may might can will would could should yea o thine those these even
nor yet than any every
hath had shalt let against hast behold now therefore thereof because
neither according am mine like own art until themselves under been none
toward whose wherefore wilt being between doth therein why concerning
thyself though moreover lest throughout while wherein lo didst thence
over whom among himself how more where both same only such through
yourselves mayest
""".split())

# Words that add nothing to a formula by standing first.
LEADING = ("and", "but", "for", "or", "nor", "yet", "so", "then", "that")

# Spellings that keep their capitals.
CAPITALS = ("LORD", "GOD", "JEHOVAH", "JAH")

# The prophetic voice tags that an echo's substance is judged without.
VOICE_TAGS = ("thus saith the lord of hosts", "saith the lord of hosts", "thus saith the lord god", "saith the lord god", "thus saith the lord", "saith the lord")

# The model's limits.
WINDOW = 5
FORMULA_LENGTHS = (2, 3, 4, 5)
ECHO_MOST = 6
CUSHION = 2.0
STRIP = 10
VARIETY_SPAN = 50
MIN_LIFT = {2: 3.0, 3: 10.0, 4: 30.0, 5: 30.0}
MIN_KEYNESS = 10.8
RARE = 2000

# Number words.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000}


def sql_list(words) -> str:
    """``words`` as an SQL list, in order."""
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"
