"""Column expressions over text. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE = r"(?<=[.!?])\s+"
LEAD_IN = r"(?i)^\s*(here\s+is\s+(the\s+)?(a\s+)?(succinct\s+|short\s+)?context[^:]*:|context:|the\s+context\s+is:?)\s*"
MATH = r"[∑∫√≤≥≠±×÷∞∂∇°·]|\\[a-zA-Z]+|\$|\^\{|_\{"
SECTION_MARK, GAP_MARK = " › ", "[…]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; none of a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """A quarter of the characters, half to even, 1 at least; 0 for an empty or null text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4))).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def sentences(text: Column) -> Column:
    """Parts after sentence ends, without blank ones."""
    return F.filter(F.split(text, SENTENCE, -1), lambda s: s.rlike(r"(?U)\S"))


def hard_split(text: Column, target: int) -> Column:
    """Slices of a text that are about target tokens long."""
    size = F.greatest(F.lit(1), F.floor(F.length(text) / F.greatest(F.lit(1), token_count(text)) * target)).cast("int")
    return F.when(F.length(text) == 0, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text), size), lambda at: F.substring(text, at, size)))


def section(header_path: Column) -> Column:
    return F.array_join(header_path, SECTION_MARK)


def embed_text(context: Column, text: Column) -> Column:
    """What is indexed: the blurb, a blank line and the chunk; the chunk alone without a blurb."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def citation(doc_id: Column, pages: Column) -> Column:
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), "-")
    return F.concat(doc_id, F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, F.concat(F.lit(", p."), listed)).otherwise(""))


def clean_context(raw: Column) -> Column:
    """A blurb without fences or quotes around it and without a lead-in."""
    t = strip(F.coalesce(raw, F.lit("")))
    fenced = t.startswith("```") & t.endswith("```")
    t = F.when(fenced, strip(t.substr(F.lit(4), F.greatest(F.lit(0), F.length(t) - 6)))).otherwise(t)
    first = F.substring(t, 1, 1)
    quoted = (F.length(t) >= 2) & first.isin('"', "'", "`") & (first == F.substring(t, -1, 1))
    t = F.when(quoted, strip(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)
    return strip(F.regexp_replace(t, LEAD_IN, ""))


def collection_name(domain_id: Column, prefix: str = "domain_") -> Column:
    """A directory-safe name; names that had to change carry a hash of the original."""
    full = F.concat(F.lit(prefix), domain_id)
    safe = F.regexp_replace(F.regexp_replace(full, r"[^a-zA-Z0-9._-]", "_"), r"\.\.+", "_")
    changed = (safe != full) | ~safe.rlike(r"[a-zA-Z0-9]\z")
    stem = F.regexp_replace(F.substring(safe, 1, 494), r"[._-]+\z", "")
    return F.when(changed, F.concat(stem, F.lit("_"), F.substring(F.sha2(domain_id, 256), 1, 8))).otherwise(F.substring(safe, 1, 512))


def legibility(text: Column) -> Column:
    """Share of letters and white space."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / n)


def clean_prose(text: Column, min_chars: int = 200, min_legibility: float = 0.85) -> Column:
    """Whether a page's text layer can be trusted: enough text, mostly letters, no formulas."""
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) >= min_chars) & (legibility(t) >= min_legibility) & ~t.rlike(MATH)


def heading_like(line: Column, max_chars: int = 64, max_words: int = 9) -> Column:
    """A short, title-like line that doesn't end as a sentence does."""
    s = strip(F.coalesce(line, F.lit("")))
    words = F.size(F.filter(F.split(s, r"\s+", -1), lambda w: w != ""))
    core = F.regexp_replace(s, r"[\"'”’»)\]}]+\z", "")
    low_start = s.rlike(r"^[^\p{L}\p{N}]*\p{Ll}")
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (s != "") & (F.length(s) <= max_chars) & (words <= max_words) & ~s.rlike(r"^([-*+]|\d+[.)])\s") & ~low_start & ~core.rlike(r"[.!?,;:]\z") & (letters * 2 >= F.length(s))


def rank_numbers(reply: Column) -> Column:
    """The integers of a reply, in order; numbers no index can have are dropped."""
    return F.transform(F.filter(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: F.length(x) <= 18), lambda x: x.cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _slot(token: Column, dim: int, hashed: str) -> Column:
    value = F.crc32(F.encode(token, "UTF-8")) if hashed == "crc32" else F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    return value % dim


def hashed_vector(text: Column, dim: int = 128, hashed: str = "crc32") -> Column:
    """Presence of tokens hashed by crc32 or md5; a text without tokens is 1e-6 everywhere."""
    slots = F.array_distinct(F.transform(tokens(text), lambda t: _slot(t, dim, hashed)))
    # as a lambda's variable the slots are found once, not once for each place of the vector
    spread = lambda s: F.when(F.size(s) == 0, F.array_repeat(F.lit(1e-6).cast("float"), dim)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.array_contains(s, k.cast("long")).cast("float")))
    return F.element_at(F.transform(F.array(slots), spread), 1)
