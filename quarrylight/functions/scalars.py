"""Column expressions shared by the layers.  All stay inside whole-stage code generation but for full Unicode folding."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of interactions, and academic titles that authors are matched without.
CONSUMPTION = ("início", "visualização", "conclusão")
COMPLETION, LIKE, SHARE, RATING = "conclusão", "curtida", "compartilhamento", "avaliação"
HONORIFICS = ("prof", "profa", "dr", "dra", "eng", "me", "ma", "msc", "phd")

_FOLDED = {c: unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0xC0, 0x250)}
_FROM = "".join(chr(c) for c, t in _FOLDED.items() if len(t) == 1)
_TO = "".join(t for t in _FOLDED.values() if len(t) == 1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text ---


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def capitalised(c: Column | str) -> Column:
    """First letter upper, all others lower: unlike initcap, only the first word changes case."""
    return F.concat(F.upper(F.left(col(c), F.lit(1))), F.lower(F.substring(col(c), 2, 1 << 30)))


def comma_decimal(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(","), F.lit("."))


def normalised(c: Column | str) -> Column:
    """Lower case without accents or punctuation, blanks collapsed.  Covers Latin letters; others are dropped."""
    ascii_ = F.regexp_replace(F.translate(col(c), _FROM, _TO), "[^\\x00-\\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", " "))


def normalised_author(c: Column | str) -> Column:
    """Normalised, without leading academic titles."""
    return F.regexp_replace(normalised(c), f"^(({'|'.join(HONORIFICS)})( |$))+", "")


def candidate_key(title="titulo", kind="tipo", author="autor") -> Column:
    return F.concat_ws("|", normalised(title), normalised(kind), normalised_author(author))


def match_key(title="titulo", kind="tipo", author="autor", level="nivel", description="descricao") -> Column:
    return F.sha2(F.concat_ws("|", candidate_key(title, kind, author), normalised(level), normalised(description)), 256)


def embedding_text(title="titulo", description="descricao") -> Column:
    """Title and description with white space collapsed, the text that is embedded."""
    return F.trim(F.regexp_replace(F.concat_ws(". ", F.trim(col(title)), F.trim(col(description))), r"\s+", " "))


# --- pseudonyms ---


def hmac_sha256(c: Column | str, key: str) -> Column:
    """Hex HMAC-SHA256 of a column's text, composed of two digests."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(col(c).cast("string"), "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def pseudonym(c: Column | str, key: str) -> Column:
    """16 hex digits of the keyed digest; refuses to work without a key."""
    if not key:
        raise ValueError("a pseudonymisation key is required")
    return F.left(hmac_sha256(c, key), F.lit(16))


def salted_pseudonym(c: Column | str, salt: str) -> Column:
    return F.concat(F.lit("usr_"), F.left(F.sha2(F.concat(col(c).cast("string"), F.lit(salt)), 256), F.lit(16)))


def masked(c: Column | str) -> Column:
    return F.concat(F.lit("usr_"), F.left(col(c), F.lit(4)), F.lit("***"), F.right(col(c), F.lit(4)))


# --- domain rules ---


def is_consumption(c: Column | str) -> Column:
    return col(c).isin(*CONSUMPTION)


def duration_band(c: Column | str) -> Column:
    return F.when(col(c) < 30, "curta").when(col(c) <= 180, "média").otherwise("longa")


def position_band(c: Column | str) -> Column:
    return F.when(col(c) <= 3, "1–3 (topo)").when(col(c) <= 6, "4–6").otherwise("7–10")


def day_part(c: Column | str) -> Column:
    h = F.hour(col(c))
    return F.when(h < 6, "madrugada").when(h < 12, "manhã").when(h < 18, "tarde").otherwise("noite")


def engagement_profile(c: Column | str) -> Column:
    return F.when(col(c) == 0, "Inativo/Explorador").when(col(c).between(1, 5), "Casual").otherwise("Engajado")


def month(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def age_months(later: Column, earlier: Column) -> Column:
    """Whole months between two dates by calendar fields; a gap below zero counts toward zero."""
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    day = F.dayofmonth(later) - F.dayofmonth(earlier)
    return F.when((months > 0) & (day < 0), months - 1).when((months < 0) & (day > 0), months + 1).otherwise(months)


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded half up; null where b is 0."""
    return F.round(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"), digits)


def rounded(c: Column, digits: int = 2) -> Column:
    """A double rounded half up after it is scaled, as the SQL does.  F.round goes by the decimal digits instead
    and makes 1.01 of 1.005, whose double lies below."""
    return F.round(c * F.lit(float(10**digits))) / F.lit(float(10**digits))


def in_month(c: str, month_: str) -> Column:
    """Whether a time without zone lies in a month (yyyy-MM), as a range that scans can push down."""
    first = F.lit(f"{month_}-01 00:00:00").cast("timestamp_ntz")
    return (F.col(c) >= first) & (F.col(c) < first + F.expr("INTERVAL 1 MONTH"))


# --- vectors ---


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null for a zero vector."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def negative_dot(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def clamped(c: Column | str) -> Column:
    return F.greatest(F.least(col(c), F.lit(1.0)), F.lit(0.0))


# --- scalar checks ---


def blank(c: Column | str) -> Column:
    return col(c).isNull() | (F.trim(col(c).cast("string")) == "")


def positive_id(c: Column | str) -> Column:
    return F.coalesce(F.try_to_number(trimmed(col(c).cast("string")), F.lit("9" * 18)) > 0, F.lit(False))


def iso_date(c: Column | str) -> Column:
    """Year, month and day; one-digit months and days pass, as dates that don't exist fail."""
    return F.coalesce(F.try_to_timestamp(col(c).cast("string"), F.lit("yyyy-M-d")).isNotNull(), F.lit(False))


def iso_datetime(c: Column | str) -> Column:
    return col(c).cast("string").rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?$") & col(c).cast("string").try_cast("timestamp_ntz").isNotNull()


def between_numbers(c: Column | str, low: float, high: float | None = None, nullable: bool = False) -> Column:
    number = col(c).cast("string").try_cast("double")
    good = (number >= low) & ~F.isnan(number)
    if high is not None:
        good = good & (number <= high)
    good = F.coalesce(good, F.lit(False))
    return good | col(c).isNull() if nullable else good


def json_list(c: Column | str) -> Column:
    return F.json_array_length(col(c)).isNotNull()


def any_of(conditions: list[Column]) -> Column:
    """True where some condition is; null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
