"""Column functions on names, texts, numbers and arrays. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question's terms leave out.
_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can "
    "cannot could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most must my myself no nor not of on once or other ought our "
    "ours ourselves out over own same she should so some such than that the their theirs them themselves then there these "
    "they this those through to too until up very was we were what when where which while who whom why with would you your "
    "yours yourself yourselves"
)
STOPWORDS = frozenset(_WORDS.split())


def normalised(x: Column) -> Column:
    """Lower case, quotes deleted, all but [a-z0-9 ] a blank, blanks collapsed and trimmed."""
    x = F.translate(F.lower(x), "'\"`\u2018\u2019\u201c\u201d", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]", " "), " +", " "))


def missing_facts(answer: Column, facts: Column) -> Column:
    """Fact groups of which no variant is in the answer; both sides normalised."""
    said = normalised(answer)
    return F.filter(facts, lambda group: ~F.exists(group, lambda v: F.contains(said, normalised(v))))


def week(ts: Column) -> Column:
    """Year and Monday-based week of the year, the days before the first Monday being week 00."""
    n = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(n.cast("string"), 2, "0"))


def compact_number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def name_like(column: Column, query: str) -> Column:
    """Case-insensitive substring; a query in s also matches without it."""
    out = F.contains(F.lower(column), F.lit(query.lower()))
    if len(query) > 2 and query[-1] in "sS":
        out = out | F.contains(F.lower(column), F.lit(query[:-1].lower()))
    return out


def without_lint(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(r"^Lint_\w+"))


def capped(items: Column, n: int) -> Column:
    """The first n, comma-joined, and how many more there are."""
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


#: What stands after a number that is a price.
PRICE_UNITS = ("c", "k", "g", "ea", "ppu", "each", "per", "council", "councils", "gold")


def has_price(x: Column) -> Column:
    """Whether a chat text quotes a price: a number after @ or before a unit, one of three or more digits after "for", or one of five
    or more anywhere. Thousands may be set off by commas, a unit may follow at once."""
    units, low = "|".join(PRICE_UNITS), F.lower(x)
    # most texts have nothing that could be a price, and one look tells: a digit after @ or for, before a unit, or one of five
    likely = F.rlike(low, F.lit(f"@[^a-z0-9_@]*+[0-9]|for[^a-z0-9_@]++[0-9]|[0-9](?:[^a-z0-9_@]*+(?:{units})(?![a-z0-9_])|(?:,*+[0-9]){{4}})"))
    parts = F.regexp_replace(F.regexp_replace(low, "@", " @ "), "[^a-z0-9_.,@]+", " ")
    parts = F.regexp_replace(parts, "(?<![a-z_0-9])([0-9][0-9,.]*+)(?=[a-z])", "$1 ")  # 500each is 500 each
    parts = F.regexp_replace(parts, "(?<![.,])[.,]++(?= |$)", "")
    # one look along the words that are left: a lambda over them would split the text anew for each
    fraction = "[0-9,]*+(?:[.][0-9]++)?+"
    digits = lambda n: f"[0-9](?:,*+[0-9]){{{n - 1}}}{fraction}"
    number = f"[0-9]{fraction}"
    quoted = F.rlike(parts, F.lit(f"(?:^| )(?:@ ++{number}|{number} ++(?:{units})|for ++{digits(3)}|{digits(5)})(?= |$)"))
    return F.when(likely, quoted).otherwise(F.lit(False))


def squeezed(x: Column) -> Column:
    """Lower case, runs of white space one blank, trimmed: the form in which names are compared."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def spaced_words(x: Column) -> Column:
    """A joined-up keyword as words: BasicMeat gives Basic Meat, XPBoost gives XP Boost."""
    apart = F.regexp_replace(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(apart, "[^A-Za-z]+", " "))


def article(x: Column) -> Column:
    return F.when(F.lower(F.substring(x, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def short_sha256(x: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, n)


def short_md5(x: Column, n: int = 8) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, n)


def grouped_number(x: Column) -> Column:
    """Rounded to whole units, thousands set off by commas."""
    return F.format_number(x.cast("double"), 0)


def table_cell(x: Column, width: int = 200) -> Column:
    """A value as the cell of a markdown table: null is empty, whole numbers lose their fraction, | is escaped, line breaks are blanks."""
    text = F.replace(F.replace(x.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.substring(F.coalesce(text, F.lit("")), 1, width)
