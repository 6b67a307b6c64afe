"""Column functions: matchers, text, versions, routes and formats. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_match(value: Column, pattern: str) -> Column:
    """Case-insensitive match of a whole value; * is any run (slashes too), ? one character."""
    escaped = "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in pattern)
    return F.coalesce(value.ilike(escaped), F.lit(False))


def any_glob(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob_match(value, p)
    return out


def first_match(value: Column, named: dict[str, list[str]], default: str | None = None) -> Column:
    """The first name, in order, one of whose globs matches."""
    return F.coalesce(*[F.when(any_glob(value, globs), F.lit(name)) for name, globs in named.items()], F.lit(default))


def folder(file: Column) -> Column:
    """The path without its last segment, empty at the root."""
    return F.when(F.instr(file, "/") > 0, F.regexp_replace(file, "/[^/]*$", "")).otherwise("")


def under(file: Column, path: str) -> Column:
    return (file == path) | file.startswith(path.rstrip("/") + "/")


def in_package(namespace: Column, package: Column) -> Column:
    """Equal, below, or matching where the package holds a star."""
    return (namespace == package) | namespace.startswith(F.concat(package, F.lit("."))) | (
        F.contains(package, F.lit("*")) & F.ilike(namespace, F.replace(F.replace(package, F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%"))))


def stem(word: Column) -> Column:
    """Plural endings off: ies becomes y in words over 4 letters, a last s goes in words over 3 that don't end in ss."""
    n = F.length(word)
    return F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y"))).when(
        (n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1)).otherwise(word)


def words(text: Column, camel: bool = False) -> Column:
    """Lower-case words of letters and digits; camel case is cut up where asked for."""
    t = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ") if camel else text
    return F.filter(F.transform(F.split(t, r"[^\p{L}\p{N}]+"), F.lower), lambda w: w != "")


def numbers(text: Column) -> Column:
    """Numbers that don't continue a word or another number, as decimals."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])\d+(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: x.cast("decimal(38,6)"))


def stated_numbers(text: Column) -> Column:
    """The numbers of a text and their hundredths, as a percentage may be meant."""
    n = numbers(text)
    return F.array_distinct(F.concat(n, F.transform(n, lambda x: (x / 100).cast("decimal(38,6)"))))


def clean_text(text: Column, most: int, fallback: Column | None = None) -> Column:
    """Control and format characters but line ends out, spaces of a line as one, empty lines out, cut at most characters with an ellipsis."""
    t = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n]]", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(F.regexp_replace(x, " +", " "))), lambda x: x != "")
    out = F.array_join(lines, "\n")
    out = F.when(F.length(out) > most, F.concat(F.rtrim(F.left(out, F.lit(most))), F.lit("…"))).otherwise(out)
    return F.when(F.coalesce(out, F.lit("")) == "", fallback if fallback is not None else F.lit("")).otherwise(out)


def slug(name: Column) -> Column:
    """Lower-case ASCII words joined by dashes; German umlauts are spelled out, other marks dropped."""
    t = F.lower(name)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy")
    return F.btrim(F.regexp_replace(t, "[^a-z0-9]+", "-"), F.lit("-"))


def route_key(verb: Column, route: Column) -> Column:
    """VERB and route for joins: lower case, no ~ or / at the ends, parameters without names."""
    path = F.regexp_replace(F.lower(F.btrim(route, F.lit("~/"))), r"\{[^}]*\}", "{}")
    return F.concat(F.upper(verb), F.lit(" "), path)


def segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda s: s != "")


def is_parameter(segment: Column) -> Column:
    """{id}, [name], :name and {{name}} stand for any segment."""
    return segment.rlike(r"^(?:\{.*\}|\[.*\]|:.+)$")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


#: A literal version: up to four numbers, prerelease labels, build data that doesn't count.
VERSION = r"^\s*(\d+(?:\.\d+){0,3})(?:-([0-9A-Za-z.\-]+))?(?:\+[0-9A-Za-z.\-]+)?\s*$"


def version_key(version: Column) -> Column:
    """A struct that orders versions: four numbers, releases after prereleases, then the prerelease labels
    (numbers before words, numbers by value). Null where the text is no version."""
    v, pre = F.regexp_extract(version, VERSION, 1), F.regexp_extract(version, VERSION, 2)
    nums = F.transform(F.slice(F.concat(F.split(v, r"\."), F.array_repeat(F.lit("0"), 4)), 1, 4), lambda x: x.cast("long"))
    label = lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("word"), F.coalesce(x.try_cast("long"), F.lit(0)).alias("n"), x.alias("s"))
    labels = F.when(pre == "", F.array().cast("array<struct<word:int,n:bigint,s:string>>")).otherwise(F.transform(F.split(pre, r"\."), label))
    return F.when(v != "", F.struct(nums.alias("numbers"), (pre == "").alias("release"), labels.alias("labels")))


def is_exact_version(version: Column) -> Column:
    return F.coalesce(version.rlike(r"^\d+(?:\.\d+){1,3}(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"), F.lit(False))


def package_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """pkg:type/name@version; names are percent-encoded, scopes keep their slash."""
    enc = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), enc(name), F.when(is_exact_version(version), F.concat(F.lit("@"), enc(version))).otherwise(""))


def change_kind(before: Column, after: Column) -> Column:
    """major, minor, patch, downgrade, same or unknown, from two versions."""
    a, b = version_key(before), version_key(after)
    n = lambda k: a["numbers"][k] != b["numbers"][k]
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "same").when(a > b, "downgrade").when(n(0), "major").when(n(1), "minor").otherwise("patch")


def short_hash(parts: Column) -> Column:
    """12 hex digits of SHA-256 of sorted strings joined by |, nulls as empty."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.transform(parts, lambda x: F.coalesce(x, F.lit("")))), "|"), 256), 1, 12)


def complexity(code: Column) -> Column:
    """1 and one for each branch word or operator."""
    return F.lit(1) + F.regexp_count(code, F.lit(r"\b(?:if|elif|for|foreach|while|case|catch|when)\b|&&|\|\||\?\?|(?<!\?)\?(?![?.:])"))


def body_slice(text: Column, first: Column, last: Column, most: int = 150) -> Column:
    """Lines first to last (from 1), at most so many."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(first, F.lit(1)), F.least(F.greatest(last - first + 1, F.lit(0)), F.lit(most))), "\n")


def parameter_names(parameters: Column) -> Column:
    """The names of '[source] name: Type' entries."""
    return F.transform(parameters, lambda p: F.btrim(F.regexp_extract(p, r"^(?:\[[^\]]*\]\s*)?([^:]+)", 1)))


def later_than(now: Column, was: Column) -> Column:
    """By time where both are timestamps (offsets count), else by text."""
    a, b = F.try_to_timestamp(now), F.try_to_timestamp(was)
    return F.when(a.isNotNull() & b.isNotNull(), a > b).otherwise(now > was)


def effect_kind(category: Column) -> Column:
    return F.when(category == "database", "db").when(category == "http-api", "http").otherwise(category)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, half-even to two places; 100 where there is nothing to count."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.bround(100.0 * part / whole, 2))


def xml_text(doc: Column, tag: str) -> Column:
    """The first <tag> of an XML comment as text: references by their last name, markup out, white space as one space."""
    body = F.regexp_extract(doc, rf"(?s)<{re.escape(tag)}(?:\s[^>]*)?>(.*?)</{re.escape(tag)}>", 1)
    body = F.regexp_replace(body, r"<(?:see|seealso|paramref|typeparamref)\s+(?:cref|name|langword)=\"(?:[A-Z]:)?(?:[^\"]*\.)?([^\"]*)\"\s*/>", "$1")
    return F.btrim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))


#: Words that carry no meaning of their own in a summary, and texts that are placeholders.
FILLER = (
    "a", "an", "the", "this", "that", "these", "its", "it", "of", "for", "to", "from", "by", "with", "in", "on", "at",
    "as", "and", "or", "is", "are", "be", "given", "specified", "provided", "current", "method", "function", "class",
    "property", "value", "object", "instance", "get", "return", "retrieve", "fetch", "set", "handle", "perform", "do",
    "call", "invoke", "execute", "run", "async", "asynchronously", "new",
)
PLACEHOLDER = (
    r"(?i)^\W*(todo|fixme|tbd|xxx|hack)\b|^\W*(summary|description)\W*$|^\W*add (a )?(summary|description)\b"
    r"|^\W*initializes a new instance of\b|\b(todo|fixme)\b:"
)


def doc_flags(text: Column, name: Column, min_words: int = 3) -> Column:
    """Flags of a written text: placeholder, too-short, and echo where its words only repeat the name's."""
    own = words(text)
    told = F.transform(F.filter(own, lambda w: ~w.isin(*FILLER) & ~stem(w).isin(*FILLER)), stem)
    known = F.transform(words(name, camel=True), stem)
    flags = [F.when(text.rlike(PLACEHOLDER), "placeholder"), F.when(F.size(own) < min_words, "too-short"), F.when(F.size(F.array_except(told, known)) == 0, "echo")]
    return F.array_compact(F.array(*flags))


def url_port(url: Column) -> Column:
    """The port of a URL, that of its scheme where none is written."""
    told = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":([0-9]+)$", 1)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(told != "", told.cast("int")).when(scheme == "https", 443).when(scheme == "http", 80)


def same_origin(source: Column, project: Column, provider: Column, repository: Column) -> Column:
    """Whether a repository of an azure-devops history is of the catalog's server, collection (source, a URL) and project.

    Scheme, host and port agree, neither URL names a user, the repository's path lies under the collection's, and
    its next part, decoded, is the project; case matters in none of them. What isn't a URL agrees with nothing.
    """
    part = lambda url, k: F.try_parse_url(url, F.lit(k))
    alike = lambda k: F.lower(part(source, k)) == F.lower(part(repository, k))
    nobody = part(source, "USERINFO").isNull() & part(repository, "USERINFO").isNull()
    prefix = F.concat(F.rtrim(part(source, "PATH"), F.lit("/")), F.lit("/"))
    path = part(repository, "PATH")
    after = F.try_url_decode(F.replace(F.substring(path, F.length(prefix) + 1, F.length(path)), F.lit("+"), F.lit("%2B")))
    under = F.startswith(F.lower(path), F.lower(prefix)) & (F.lower(F.split(after, "/")[0]) == F.lower(project))
    return F.coalesce((provider == "azure-devops") & alike("PROTOCOL") & alike("HOST") & (url_port(source) == url_port(repository)) & nobody & under, F.lit(False))
