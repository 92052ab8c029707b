"""Column functions on source text, tags, records and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that normalisation folds, and the comment forms of C.
WHITE = r"[\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"
DIRECTIVE = r"(?m)^[ \t]*#(?>[^\n\\]|\\\n)*+"
CVE = r"CVE-\d{4}-\d+"
DEFAULT_TAG_VERSION = r"^(?:v)?(.+)$"
RELEASE_TAG = r"^(?:mbedtls-)?v?(\d+)\.\d+\.\d+(?:\.\d+)?$"
RELEASE_MAJORS = (2, 3)
RECORD_FIELDS = ("vendor", "component", "version", "date", "license", "purl", "url")


def decode(content: Column) -> Column:
    """Bytes as UTF-8, faults replaced."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def normalize(text: Column) -> Column:
    """Every C comment and run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, COMMENT, " "), WHITE, " "))


def sha256_hex(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def md5_hex(content: Column) -> Column:
    return F.md5(content)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def strip_code(text: Column) -> Column:
    """Text without comments and preprocessor lines with their continuations."""
    return F.regexp_replace(F.regexp_replace(text, COMMENT, " "), DIRECTIVE, " ")


def prototypes(stripped: Column, prefix: str) -> Column:
    """Distinct names with the prefix (a pattern) that are declared: a type, blanks or stars, the name, a parenthesis."""
    pattern = rf"\b[A-Za-z_]\w*(?:{WHITE[:-1]}|\*)+((?:{prefix})\w*){WHITE[:-1]}*\("
    return F.array_sort(F.array_distinct(F.regexp_extract_all(stripped, F.lit(pattern), F.lit(1))))


def tag_version(tag: Column, pattern: str = DEFAULT_TAG_VERSION) -> Column:
    """The pattern's group, or the tag itself."""
    return F.coalesce(F.nullif(F.regexp_extract(tag, pattern, 1), F.lit("")), tag)


def in_release_scope(tag: Column, majors: tuple[int, ...] = RELEASE_MAJORS) -> Column:
    """Release tags of three or four numbers whose major version is wanted."""
    return F.regexp_extract(tag, RELEASE_TAG, 1).isin(*[str(m) for m in majors])


def mint_id(purl: Column, version: Column) -> Column:
    return F.md5(F.concat_ws("@", purl, version))


def split_record(record: Column) -> Column:
    """struct<path, url, cnt> of path,url,count, split from the right: a path may hold commas."""
    part = lambda i: F.regexp_extract(record, r"(?s)^(.*),([^,]*),([^,]*)$", i)
    sound = record.rlike(r"(?s)^.*,[^,]*,[^,]*$")
    count = F.when(part(3).rlike(r"^\d{1,18}$"), part(3)).cast("long")
    return F.struct(F.when(sound, part(1)).alias("path"), F.when(sound, part(2)).alias("url"), F.when(sound, count).alias("cnt"))


def url_host(url: Column) -> Column:
    """Host of an http(s) URL that has a path, else the first 40 characters."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^https?://([^/]+)/", 1), F.lit("")), F.left(url, F.lit(40)))


def declared_fields(record: Column) -> Column:
    """struct of the seven declared fields; surplus ones are cut off, missing ones null."""
    parts = F.split(record, ",")
    return F.struct(*[F.get(parts, i).alias(n) for i, n in enumerate(RECORD_FIELDS)])


def release_and_path(record: Column) -> Column:
    """struct<release_id, path> of 16 bytes of id and the rest."""
    return F.struct(F.lower(F.hex(F.substring(record, 1, 16))).alias("release_id"), F.call_function("make_valid_utf8", F.substring(record, 17, 1 << 30).cast("string")).alias("path"))


def cve_ids(json: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(json, F.lit(f"({CVE})"), F.lit(1))))


def quote_cpe(cpe: Column) -> Column:
    """URL quoting that keeps slashes and writes blanks as %20."""
    return F.replace(F.replace(F.url_encode(cpe), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def or_default(value: Column, default: Column) -> Column:
    """value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def shard_byte(file_name: Column) -> Column:
    return F.conv(F.nullif(F.regexp_extract(file_name, r"([0-9a-fA-F]{2})\.ldb$", 1), F.lit("")), 16, 10).cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def version_key(version: Column) -> Column:
    """Numbers of a version as an array, for numeric comparison (2.28.8 before 2.28.10)."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("long"))


# What comes before a release, in order, and what comes after it.
BEFORE_RELEASE = (("dev", "snapshot", "nightly"), ("alpha", "a"), ("beta", "b"), ("rc", "pre", "preview", "c"))
AFTER_RELEASE = ("p", "patch", "pl", "post", "sp", "update", "u", "r", "rev")


def version_order(version: Column) -> Column:
    """struct<numbers, phase, letter, step> that sorts as versions do; null for a text without a digit.

    Numbers before the first other part count, zeros at their end do not: 2.28 = 2.28.0 < 2.28.0.1 < 2.28.8 < 2.28.10. A word
    that comes before a release sorts below it with its number (3.6.0-alpha2 < 3.6.0-rc1 < 3.6.0), one that comes after it,
    or a single letter right behind the numbers, above (1.0.2 < 1.0.2a < 1.0.2-patch1). Anything else behind the numbers (build names) is as good as the release. What stands before the
    first digit is a scheme's name and does not count.
    """
    rest = F.regexp_extract(F.lower(version), r"^[^0-9]*([0-9].*)$", 1)
    main = F.regexp_extract(rest, r"^([0-9]{1,18}(?:[._][0-9]{1,18})*)", 1)
    numbers = F.transform(F.regexp_extract_all(main, F.lit(r"([0-9]{1,18})"), F.lit(1)), lambda x: x.cast("long"))
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    tail = F.substring(rest, F.length(main) + 1, F.length(rest))
    word = F.regexp_extract(tail, r"^[-._+~]?([a-z]+)", 1)
    step = F.coalesce(F.when(word != "", F.nullif(F.regexp_extract(tail, r"^[-._+~]?[a-z]+[-._]?([0-9]{1,18})", 1), F.lit("")).cast("long")), F.lit(0).cast("long"))
    joined = tail.rlike("^[a-z](?![a-z0-9])")
    before = list(enumerate(BEFORE_RELEASE))
    phase = F.when(joined, len(before) + 1)
    for i, words in before:
        phase = phase.when(word.isin(*words), i)
    phase = phase.when(word.isin(*AFTER_RELEASE), len(before) + 2).otherwise(len(before))
    letter = F.when(joined, word).otherwise("")
    counts = word.isin(*[w for _, words in before for w in words], *AFTER_RELEASE)
    order = F.struct(F.slice(numbers, F.lit(1), last).alias("numbers"), phase.alias("phase"), letter.alias("letter"), F.when(counts & ~joined, step).otherwise(0).alias("step"))
    return F.when(rest != "", order)
