"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"
CJK_SHARE = 0.3
PREVIEW = 200


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row: inside a lambda, a column from outside is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(chars: Column, n: int) -> Column:
    """All runs of n neighbours of an array of characters, joined, in time proportional to the array."""
    out = chars
    for k in range(1, n):
        out = F.zip_with(F.slice(out, 1, F.greatest(F.size(chars) - k, F.lit(0))), F.slice(chars, k + 1, F.size(chars)), lambda a, b: F.concat(a, b))
    return out


def character_runs(flat: Column, n: int) -> Column:
    """The n-grams of a text; a shorter text is its own, an empty one has none."""
    none = F.array().cast("array<string>")
    whole = lambda f: F.when(F.length(f) == 0, none).when(F.length(f) < n, F.array(f)).otherwise(bound(F.split(f, ""), lambda c: windows(c, n)))
    return bound(flat, whole)


def clean_text(text: Column) -> Column:
    """Without URLs, mail addresses and the signs {}[]"\\=#; white space collapsed."""
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+", "")
    text = F.regexp_replace(text, r"\S+@\S+", "")
    text = F.regexp_replace(text, r'[{}\[\]"\\=#]', " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def mostly_cjk(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    rest = F.length(F.regexp_replace(text, CJK, ""))
    return F.when(F.length(text) == 0, False).otherwise((F.length(text) - rest) / F.length(text) > CJK_SHARE)


def tokenize(text: Column, segment: Callable[[Column], Column] | None = None) -> Column:
    """White-space tokens with their case; mostly-CJK text by ``segment``, or by character without one."""
    plain = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    cjk = segment(text) if segment else F.regexp_extract_all(text, F.lit(f"({CJK}|[A-Za-z0-9_]+)"), 1)
    return F.when(mostly_cjk(text), cjk).otherwise(plain)


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Sliding character n-grams of the cleaned text without spaces; a shorter text is its own n-gram."""
    return character_runs(F.regexp_replace(clean_text(F.coalesce(text, F.lit(""))), " ", ""), n)


def expand_synonyms(query: str, synonyms: Mapping[str, str]) -> list[str]:
    """The query, and its form with every synonym replaced, longest first."""
    query = (query or "").strip()
    changed = query
    for source in sorted(synonyms, key=lambda s: (-len(s), s)):
        changed = changed.replace(source, synonyms[source])
    return list(dict.fromkeys(q for q in (query, changed) if q))


def expand_synonyms_column(query: Column, synonyms: Mapping[str, str]) -> Column:
    out = F.trim(query)
    for source in sorted(synonyms, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(source), F.lit(synonyms[source]))
    return F.array_distinct(F.filter(F.array(F.trim(query), out), lambda q: q != ""))


def core_tokens(variants: Column, light: Sequence[str] = ()) -> Column:
    """Distinct lower-case tokens of all variants, two characters or more, without light words, in order."""
    words = F.flatten(F.transform(variants, lambda v: tokenize(F.lower(F.trim(v)))))
    dropped = F.array(*[F.lit(w) for w in light]).cast("array<string>")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~F.array_contains(dropped, t)))


def core_hits(text: Column, core: Column) -> Column:
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.size(F.filter(core, lambda t: F.contains(low, t))))


def item_name(text: Column, keys: Sequence[str]) -> Column:
    """The first non-blank value among ``keys`` of a JSON object, without brackets round it; "" if there is none."""
    parsed = F.from_json(text, "map<string,string>")
    found = F.coalesce(*[F.nullif(F.trim(F.element_at(parsed, F.lit(k))), F.lit("")) for k in keys])
    return F.coalesce(F.regexp_replace(found, r"^[\[\]【】]+|[\[\]【】]+$", ""), F.lit(""))


def mixed_tokens(text: Column) -> Column:
    """Distinct lower-case Latin words and single CJK characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([A-Za-z0-9_]+|{CJK})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def same_tokens(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def identifier(text: Column, prefix: str = "t_") -> Column:
    """Lower-case letters, digits and underscores; a name that is empty or begins with a digit gets the prefix."""
    name = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", ""))
    return F.when((name == "") | name.rlike("^[0-9]"), F.concat(F.lit(prefix), name)).otherwise(name)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def preview(text: Column, size: int = PREVIEW) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) / 4


def redacted(text: Column) -> Column:
    return F.coalesce(F.substring(F.sha2(text, 256), 1, 12), F.lit("none"))


def md5_short(text: Column, size: int = 32, salt: str = "") -> Column:
    return F.substring(F.md5(F.concat(text, F.lit(salt))), 1, size)


def model_name(text: Column) -> Column:
    """Lower case; one kind of joint, the hyphen where there is one; letters, digits and joints only, none at the ends."""
    low = F.regexp_replace(F.lower(text), "[ -]+", "-")
    joined = F.when(F.contains(low, F.lit("-")), F.replace(low, F.lit("_"), F.lit("-"))).otherwise(low)
    return F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9_-]", ""), "^[-_]|[-_]$", "")


def decoded(text: Column) -> Column:
    """What Base64 text stands for, if that is valid UTF-8; else the text."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def stable_uuid(text: Column) -> Column:
    """Version-5 UUID of the SHA-256 hex of ``text`` in the all-zero name space."""
    hexes = F.sha1(F.concat(F.unhex(F.lit("0" * 32)), F.sha2(text, 256).cast("binary")))
    # version 5 and variant bits
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(hexes, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.concat(F.lit("5"), F.substring(hexes, 14, 3)),
        F.concat(variant, F.substring(hexes, 18, 3)), F.substring(hexes, 21, 12),
    )


def merged_json(meta: Column, text: Column) -> Column:
    """``meta`` (a map) merged into a JSON object, whose own keys win; other text as it is."""


    def merged(own: Column) -> Column:
        more = F.map_filter(meta, lambda k, v: ~F.map_contains_key(own, k))
        return F.when(F.trim(text).startswith("{") & own.isNotNull(), F.to_json(F.map_concat(own, more))).otherwise(text)

    return bound(F.from_json(text, "map<string,string>"), merged)


def chosen_fields_json(df_columns: Sequence[str]) -> Column:
    """JSON object of the non-empty columns among ``df_columns``, in their order."""
    return F.to_json(F.struct(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df_columns]))


def simhash_bits(text: Column, width: int = 4) -> Column:
    """64-bit SimHash over character shingles, by their MD5, as an array of 64 zeros and ones."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w一-鿿]+", "")
    grams = bound(flat, lambda f: F.when(F.length(f) < width, F.array(f)).otherwise(bound(F.split(f, ""), lambda c: windows(c, width))))
    # the last 16 hex digits of each shingle's MD5, as two numbers of 32 bits
    half = lambda digest, at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    halves = F.transform(F.transform(grams, F.md5), lambda d: F.struct(half(d, 17).alias("high"), half(d, 25).alias("low")))

    def bits(rows: Column) -> Column:
        ones = lambda name, k: F.size(F.filter(rows, lambda r: r[name].bitwiseAND(F.lit(1 << k)) != 0))
        return F.array(*[(ones(name, k) * 2 > F.size(rows)).cast("int") for name in ("high", "low") for k in range(31, -1, -1)])

    return bound(halves, bits)


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + d) / 64
