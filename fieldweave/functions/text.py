"""Column functions over text: cleaning, classification by rules, keys, hashes and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The edge of a word of ASCII letters, digits and underscores, as RE2's \b; Java's own counts letters beyond ASCII up to version 18.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# The word rules by which prose descriptions of plays are told apart.
NOT_A_PLAY = r"(?i)\b(punt|field goal|kickoff|kneel|spike|timeout|end of|no play)\b"
PASS_WORDS = r"(?i)\b(pass|sacked|scramble)\b"
SCRIMMAGE_WORDS = r"(?i)\b(pass|sacked|scramble|left end|left tackle|left guard|up the middle|right guard|right tackle|right end)\b"
UNFILMED_WORDS = r"(?i)\b(timeout|end of (quarter|game)|two.minute warning|coin toss)\b"
FILMED_WORDS = r"(?i)\b(punt|kickoff|field goal|extra point|penalty|false start|offsides|no play)\b"
FILMED_KINDS = ["run", "pass", "punt", "kickoff", "field_goal", "extra_point", "qb_kneel", "qb_spike", "no_play", "penalty"]


def squeezed(c: Column) -> Column:
    """Runs of white space become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_int(c: Column) -> Column:
    """The first run of digits as a number, or null."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def nullable_int(c: Column) -> Column:
    """Text as a number, cut toward zero ('1.9' is 1); null tokens and other text are null."""
    token = F.trim(c.cast("string"))
    return F.when(~F.lower(token).isin("", "na", "nan"), token.try_cast("double").cast("int"))


def null_tokens(c: Column) -> Column:
    """'', NA, NaN and nan are null."""
    return F.when(~c.isin("", "NA", "NaN", "nan"), c)


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def by_rules(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that the text has."""
    out = None
    for pattern, label in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(otherwise)


def play_type(description: Column) -> Column:
    """excluded, pass, run or administrative; the first three by word rules, in this order."""
    return by_rules(squeezed(description), [(NOT_A_PLAY, "excluded"), (PASS_WORDS, "pass"), (SCRIMMAGE_WORDS, "run")], "administrative")


def eligible_by_flags(kind: Column, *flags: Column) -> Column:
    """A pass or a run with none of the flags set; a null flag is not set."""
    out = F.coalesce(kind.isin("pass", "run"), F.lit(False))
    for flag in flags:
        out = out & (F.coalesce(flag.cast("int"), F.lit(0)) == 0)
    return out


def is_filmed(description: Column, kind: Column, unfilmed: str = UNFILMED_WORDS, kinds: list[str] = FILMED_KINDS, filmed: str = FILMED_WORDS) -> Column:
    """Never if the unfilmed pattern is there; else by kind or by the filmed pattern."""
    text = F.coalesce(description, F.lit(""))
    return ~text.rlike(unfilmed) & (F.coalesce(kind.isin(*kinds), F.lit(False)) | text.rlike(filmed))


def event_category(description: Column, kind: Column) -> Column:
    """By words of the text in order of priority, else the kind if it is run or pass."""
    low = F.lower(F.coalesce(description, F.lit("")))
    words = [("punt", ["punt"]), ("kickoff", ["kickoff"]), ("place_kick", ["field goal", "extra point"]), ("no_play", ["false start", "no play"])]
    cases = [(label, [low.contains(w) for w in any_of]) for label, any_of in words]
    found = F.coalesce(*[F.when(F.greatest(*[t.cast("int") for t in tests], F.lit(0)) == 1, F.lit(label)) for label, tests in cases])
    return F.coalesce(found, F.when(kind.isin("run", "pass"), kind), F.lit("unknown"))


def trailing_number(c: Column) -> Column:
    """The number after the last colon: 'game:17' is 17."""
    return F.nullif(F.regexp_extract(c, r":(\d+)$", 1), F.lit("")).cast("long")


def game_key(season: Column, week: Column, away: Column, home: Column) -> Column:
    return F.format_string("%d_%02d_%s_%s", season.cast("int"), week.cast("int"), F.upper(away), F.upper(home))


def line_candidates(position: Column, owner: Column) -> Column:
    """'SIDE NN' as the two places along the field that it can mean; null if it can't be read.

    Places are 10 to 110. With the owner's own side the first is on the near half; 50 or MID is the middle twice.
    """
    parts = F.split(F.upper(F.trim(position)), r"\s+")
    side, yard = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("int")
    near, far = (yard + 10).cast("double"), (F.lit(110) - yard).cast("double")
    pair = F.when((yard == 50) | side.isin("MID", "50"), F.array(F.lit(60.0), F.lit(60.0)))
    pair = pair.when(yard.between(1, 49), F.when(side == F.upper(owner), F.array(near, far)).otherwise(F.array(far, near)))
    return F.when((F.size(parts) == 2) & yard.isNotNull() & owner.isNotNull(), pair)


def is_safe_id(c: Column, pattern: str = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def without_query(url: Column) -> Column:
    """A URL without what stands after its question mark."""
    return F.regexp_replace(url, r"\?.*$", "?<redacted>")


def hash_unit(c: Column) -> Column:
    """The first 8 hexadecimal digits of SHA-256 as a number of 0 to 1."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def digest16(c: Column) -> Column:
    """16 hexadecimal digits for a configuration in canonical JSON."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def json_or(c: Column, schema: str, default: str = "{}") -> Column:
    return F.from_json(F.coalesce(c, F.lit(default)), schema)


def without_comment_marks(html: Column) -> Column:
    """Markup with what its comments hold as ordinary content."""
    return F.regexp_replace(html, r"<!--|-->", "")


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def tag_bodies(html: Column, tag: str) -> Column:
    """What stands in each element of this name, elements not nested in their like."""
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}{EDGE}[^>]*>(.*?)</{tag}>"), F.lit(1))


# Names of characters in markup.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "\u2013", "mdash": "\u2014", "frac12": "\u00bd", "amp": "&"}


def unescaped(c: Column) -> Column:
    """Numbers of characters and the most common names of them as the characters themselves."""

    def of_number(part: Column) -> Column:
        number = F.regexp_extract(part, r"^([0-9]+|[xX][0-9a-fA-F]+);", 1)
        value = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0")), "UTF-32")
        return F.when(value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF), F.concat(char, F.regexp_replace(part, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(c, "&#")
    c = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), of_number), ""))
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def joined_text(markup: Column) -> Column:
    """The texts between tags, each without white space at its ends, joined by spaces."""
    strip = lambda t: F.regexp_replace(unescaped(t), r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    return F.array_join(F.filter(F.transform(F.split(markup, "<[^>]*>"), strip), lambda t: t != ""), " ")


def plain_text(markup: Column) -> Column:
    return squeezed(F.regexp_replace(markup, r"<[^>]+>", ""))
