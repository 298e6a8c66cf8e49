"""Text functions (STR-*): normalising, previews, scrubbing, identifiers, routes, file names, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware trimming sees it.
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# What is masked in descriptions.
PATH_WINDOWS = r"[A-Za-z]:\\[^\s]{6,}"
PATH_UNIX = r"(?i)/(?:Users|home|var|etc|Windows)[^\s]{3,}"
EMAIL = r"(?i)[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}"  # the name never gives back: no @ is in it
IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def normalize(c: Column) -> Column:
    """STR-2: line ends to LF, NUL dropped, three or more line ends to two."""
    return F.regexp_replace(F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\x00"), F.lit("")), r"\n{3,}", "\n\n")


def collapse(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def clamp(c: Column, limit: int, trim: bool = False) -> Column:
    """STR-3, STR-4, STR-5: at most ``limit`` characters, the last an ellipsis if any were cut."""
    head = F.left(c, F.lit(limit - 1))
    return F.when(F.length(c) > limit, F.concat(trim_end(head) if trim else head, F.lit("…"))).otherwise(c)


def preview(c: Column, limit: int = 280, trim: bool = False) -> Column:
    return clamp(collapse(c), limit, trim)


def scrub(c: Column, limit: int | None = 180) -> Column:
    """STR-6: white space, paths, mail addresses and IPv4 numbers, in this order; null gives the empty text. No limit: not cut."""
    out = collapse(c)
    for pattern, mask in ((PATH_WINDOWS, "[path]"), (PATH_UNIX, "[path]"), (EMAIL, "[email]"), (IPV4, "[ip]")):
        out = F.regexp_replace(out, pattern, mask)
    return F.coalesce(out if limit is None else clamp(out, limit), F.lit(""))


def issue_message(c: Column, limit: int = 280) -> Column:
    """STR-7: the first line, without paths."""
    line = F.regexp_replace(F.split_part(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\n"), F.lit(1)), r"[A-Za-z]:\\[^\s]+", "[path]")
    return clamp(trim_all(F.regexp_replace(line, r"(?:/[A-Za-z0-9._-]+){2,}", "[path]")), limit)


def after_thinking(c: Column, marker: str = "</think>") -> Column:
    """STR-8: what follows the last marker."""
    return trim_all(F.substring_index(c, marker, -1))


def extension(name: Column) -> Column:
    """STR-9: lower-case extension without the dot; a leading dot is no extension."""
    return F.lower(F.regexp_extract(name, r"[^/\\]\.([^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def slashed(path: Column) -> Column:
    """STR-10: forward slashes, lower case."""
    return F.lower(F.translate(path, "\\", "/"))


def inside(path: Column, root: Column) -> Column:
    """FLT-9: whether a path is the root or below it, by components."""
    return (path == root) | F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def ancestors(path: Column) -> Column:
    """CHK-6: all proper prefixes of a slash-separated path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def digest(*columns: Column, size: int = 64, sep: str = "|", prefix: str = "") -> Column:
    """HASH-1: the first hexadecimal digits of the SHA-256 of the joined columns."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws(sep, *columns), 256), F.lit(size)))


def identifiers(c: Column) -> Column:
    """STR-16: all identifiers in order."""
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))


def code_shaped(name: Column) -> Column:
    """STR-17."""
    return F.contains(name, F.lit("$")) | (F.contains(name, F.lit("_")) & name.rlike("[A-Za-z]")) | name.rlike("[a-z][A-Z]") | name.rlike("[A-Z][a-z]+[A-Z]")


def bare_code(c: Column) -> Column:
    """STR-15: comments and the contents of strings taken out."""
    for pattern, to in (
        (r"/\*[\s\S]*?\*/", " "),
        (r"(?m)^\s*\*.*$", " "),
        (r"(?m)(^|[^:])//.*$", "$1"),
        (r"'(?:\\.|[^'\\])*'", "''"),
        (r'"(?:\\.|[^"\\])*"', '""'),
        (r"`(?:\\.|[^`\\])*`", "``"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def api_routes(c: Column) -> Column:
    """STR-18: quoted then logged routes, without trailing slashes, distinct, longer than four characters."""
    # The forms of quoted and logged routes.
    route = r"(/api/[A-Za-z0-9][A-Za-z0-9_/-]*)"
    quoted = F.regexp_extract_all(c, F.lit(rf"(['\"`]){route}\1"), F.lit(2))
    logged = F.regexp_extract_all(c, F.lit(rf"(?i)['\"`](?:GET|POST|PUT|PATCH|DELETE)\s+{route}"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(quoted, logged), lambda r: F.regexp_replace(r, "/+$", "")), lambda r: F.length(r) > 4))


#: Verbs that promise an action.
COMMITMENT_VERBS = "fetch retrieve get read open check inspect examine review look search find list load pull call use run rename move copy create verify scan query".split()
COMMITMENT = (
    r"(?i)^(?:(?:next|now|then|first),?\s+)?(?:i'll|i will|i'm going to|i am going to|let me)\s+(?:(?:now|next|then|first|also|quickly|go ahead and)\s+)*(?:"
    + "|".join(COMMITMENT_VERBS)
    + r")\b"
)


def promises_action(c: Column) -> Column:
    """STR-20: whether one of the last two sentences begins with a promise to act."""
    plain = collapse(F.regexp_replace(c, "[‘’]", "'"))
    sentences = F.filter(F.transform(F.split(plain, r"(?<=[.!?:])\s+"), lambda s: trim_all(F.regexp_replace(s, r"^[\s*_\-\"'>]+", ""))), lambda s: s != "")
    return F.coalesce(F.exists(F.slice(sentences, F.greatest(F.size(sentences) - 1, F.lit(1)), 2), lambda s: s.rlike(COMMITMENT)), F.lit(False))


def process_base(name: Column) -> Column:
    """STR-25: lower case without .exe."""
    return F.regexp_replace(F.lower(name), r"\.exe$", "")


def names_match(process: Column, faulting: Column) -> Column:
    """STR-19: any of five forms of likeness; they all imply that the faulting name contains the process name."""
    a, b = process_base(process), process_base(faulting)
    return F.coalesce((a != "") & (b != "") & F.contains(b, a), F.lit(False))


def error_status(c: Column, typed: Column) -> Column:
    """STR-28: a typed status as it is, unreachable services 503, what the caller did wrong 400, else 500."""
    low = F.lower(c)
    return F.coalesce(typed, F.when(low.rlike("econnrefused|not running|unreachable|not installed"), 503).when(low.rlike("required|must be|invalid|not found|unknown|cannot be"), 400).otherwise(500))
