"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that are taken off a query word, in the order in which they are tried.
PARTICLES = [
    "으로서", "으로써", "에서는", "에게는", "이라고", "라고", "에서", "에게", "부터", "까지",
    "하고", "이랑", "으로", "이나", "인가요", "인가", "나요", "까요", "은", "는", "이", "가",
    "을", "를", "에", "의", "와", "과", "도", "만", "로", "요",
]
# Words that carry no meaning in a query.
STOP_WORDS = [
    "어떤", "무엇", "뭐", "누구", "언제", "어디", "어떻게", "얼마", "왜", "그리고", "하는", "있나",
    "있나요", "있어요", "해주세요", "알려", "알려줘", "알려주세요", "무슨", "관련", "내용", "정리",
    "what", "which", "who", "when", "where", "how", "the", "and", "for", "you", "your", "are", "is",
]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""
    grams = F.transform(words(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def similarity_to(grams: Column, wanted: list[str]) -> Column:
    """Jaccard similarity of a trigram array to a fixed one, by the sizes of both and of what they share."""
    if not wanted:
        return F.lit(0.0)
    shared = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in wanted]))).cast("double")
    return shared / (F.size(grams) + len(wanted) - shared)


def strip_particle(word: Column) -> Column:
    """The word without the first listed ending that leaves two characters or more."""
    branches = reduce(lambda when, p: when.when(word.endswith(p) & (F.length(word) > len(p) + 1), F.substr(word, F.lit(1), F.length(word) - len(p))), PARTICLES[1:], F.when(word.endswith(PARTICLES[0]) & (F.length(word) > len(PARTICLES[0]) + 1), F.substr(word, F.lit(1), F.length(word) - len(PARTICLES[0]))))
    return branches.otherwise(word)


def query_terms(text: Column, limit: int = 8) -> Column:
    """Search terms of a query: words of two characters or more, without endings and stop words, each once."""
    raw = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    kept = F.filter(F.transform(raw, strip_particle), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether the lower-cased text contains a term; false for no terms."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(t)) for t in terms], F.lit(False))


def clean(text: Column) -> Column:
    """LF line ends, no blanks at line ends, at most one blank line, nothing around."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ \t\n]+|[ \t\n]+$", "")


def slugify(name: Column, default: str = "repo") -> Column:
    """Lower-case a-z, digits and Hangul, other runs as one hyphen, at most 100 characters."""
    slug = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^a-z0-9가-힣]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.substr(F.when(slug == "", default).otherwise(slug), F.lit(1), F.lit(100))


def clean_name(name: Column) -> Column:
    """Last path part, without NUL and blanks or dots around; null where nothing is left; at most 255 characters."""
    last = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    last = F.regexp_replace(F.regexp_replace(last, "\x00", ""), r"^\s+|\s+$", "")
    last = F.regexp_replace(last, r"^[. ]+|[. ]+$", "")
    return F.when(last != "", F.substr(last, F.lit(1), F.lit(255)))


def safe_stem(name: Column, default: str = "card") -> Column:
    """A file stem of letters, digits, blanks and -_() only, at most 80 characters."""
    stem = F.substr(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} \-_()]", "")), F.lit(1), F.lit(80))
    return F.when(stem == "", default).otherwise(F.coalesce(stem, F.lit(default)))


def key_name(name: Column) -> Column:
    """A key: lower-case letters, digits, _ and -, at most 60."""
    return F.substr(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\-]", ""), F.lit(1), F.lit(60))


def label_terms(label: Column) -> Column:
    """Terms of a taxonomy label, its separators as blanks."""
    return F.filter(F.split(F.lower(F.translate(label, ">·/", "   ")), r"\s+"), lambda w: w != "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, n: int = 160) -> Column:
    """One line, cut after n characters with an ellipsis."""
    line = one_line(text)
    return F.when(F.length(line) > n, F.concat(F.substr(line, F.lit(1), F.lit(n)), F.lit("…"))).otherwise(line)


def summary(text: Column, heading: Column, title: Column) -> Column:
    """The first 400 characters as one line, after the heading or else the title."""
    lead = F.when(F.coalesce(heading, F.lit("")) != "", heading).otherwise(F.coalesce(title, F.lit("")))
    return F.concat(F.when(lead != "", F.concat(lead, F.lit(": "))).otherwise(F.lit("")), F.substr(one_line(text), F.lit(1), F.lit(400)))


def mask(secret: Column) -> Column:
    """Stars for up to eight characters, else the first and last four around an ellipsis."""
    n = F.length(secret)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substr(secret, F.lit(1), F.lit(4)), F.lit("…"), F.substr(secret, n - 3, F.lit(4))))


def title_of(message: Column) -> Column:
    """The first line, at most 80 characters."""
    return F.substr(F.substring_index(F.regexp_replace(message, r"^\s+|\s+$", ""), "\n", 1), F.lit(1), F.lit(80))


#: A word or a single other mark: the offline stand-in for a model's token.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def lenient_json(text: Column) -> Column:
    """JSON inside a model's answer, as text: without code fence, whole, or from the first to the last bracket; else null."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    whole = F.to_json(F.try_parse_json(bare))
    return F.coalesce(whole, F.to_json(F.try_parse_json(F.when(inner != "", inner))))


def cite(n: Column, path: Column, heading: Column, page: Column) -> Column:
    """``[n] path > heading p.page``."""
    heading = F.when(F.coalesce(heading, F.lit("")) != "", heading)
    where = F.concat_ws(" > ", F.regexp_replace(path, "^/+", ""), heading)
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), where, F.when(page > 0, F.concat(F.lit(" p."), page.cast("string"))).otherwise(F.lit("")))


def embed_text(heading: Column, body: Column) -> Column:
    """What is embedded of a part: its heading path, where it has one, above its text."""
    head = F.regexp_replace(F.coalesce(heading, F.lit("")), r"^\s+|\s+$", "")
    return F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body)


def email_key(address: Column) -> Column:
    return F.lower(F.regexp_replace(address, r"^\s+|\s+$", ""))


def iso_time(at: Column) -> Column:
    """A UTC time as ISO 8601: microseconds where there are any, and the offset."""
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def elapsed_ms(begin: Column, end: Column) -> Column:
    """Whole milliseconds between two times."""
    return F.floor((F.unix_micros(end) - F.unix_micros(begin)) / 1000)


def contains_text(column: Column, part: str) -> Column:
    """Whether a text contains a part, case aside; the part is taken literally. An empty part asks for nothing."""
    return F.lit(True) if not part else F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(part.lower()))
