"""Personal data: base patterns, and further spans by weak supervision.

Base spans are regular expressions with checks. Candidates for further spans come from wider patterns.
Labelers vote (-1, 0, 1) on every span: the regex labeler on its form, check digits and ranges; the gazetteer labeler on
its tokens, by tables of names, countries, issuers and prefixes; context labelers on cue words around it and what
precedes it, on its characters and on its edges. The votes' patterns are counted over all documents; expectation-maximisation (two latent classes, labelers independent given
the class) estimates each labeler's reliability from the counts, and a logistic span classifier is trained
on the resulting class probabilities, over votes, kind and length. Its weights become a column expression.

The texts are scanned twice, in place, by built-in functions: once to count, once to return spans. The
only thing collected is the table of vote patterns, at most 8 * 3^5 * 4 rows whatever the input.
Quantifiers are possessive, so that a very long run of digits or letters costs linear time and no stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of, unpacked

LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns. They match what the plain forms match; \G lets an address start right after another.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?[\[(.](?:dot|DOT)?[\]).]?\x20?[A-Za-z0-9-]{2,32}+){1,4}+",
    "secret": r"(?<=(?:token|secret|password|passwd|api.?key|TOKEN|SECRET|PASSWORD|API.?KEY)\x20{0,2}[=:]\x20{0,2}\"{0,1})[A-Za-z0-9+/_-]{16,128}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra)\.?\x20[A-Z][a-z]{1,30}+(?:\x20[A-Z][a-z]{1,30}+)?+(?![A-Za-z])",
}
#: What a text must hold for a pattern to match at all; texts without it, most of them, aren't scanned further.
HOLDS = {
    "email": ("@",), "phone": ("+",), "ip": (".",), "card": (), "secret": ("=", ":"), "ssn": ("-",), "iban": (),
    "name": ("Mr", "Ms", "Dr", "Herr", "Frau", "Mme", "Sra"), "wide email": ("(at)", "[at]", "(AT)", "[AT]"),
}
WITH_DIGITS = ("phone", "ip", "card", "ssn", "iban")
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban", "name")
#: Cue words of the context labeler, and words before numbers that are not personal.
CUES = r"(?i)mail|phone|tel|mobil|call|fax|card|karte|carte|tarjeta|visa|konto|account|iban|ssn|social|token|secret|passw|key|contact|kontakt|addr|\bip\b|host|server|mr|mrs|dr|herr|frau"
AGAINST = r"(?i)\b(?:version|vers|v|no|nr|num|page|seite|fig|isbn|issn|doi|section|chapter|id|release|license)[.:#]?\x20?$"
#: Fixed values, the gazetteer's tables: given and family names, IBAN lengths by country, domains, what secrets and cards begin with, calling codes.
NAMES = """alice ana andrea anna antoine ben bob carlos carmen charles christian claire daniel david elena emma erik eva felix fatima francois
frank george hannah hans helen ines isabel jack james jan jean jennifer joe john jose juan julia karl kate laura lea leon linda lisa louis lucas
luis maria marie mark marta martin mary max mia michael miguel mohammed nina noah nora olga oliver omar oscar paul pedro peter philipp pierre rosa
ruth sam sara sofia sophie stefan susan theo thomas tim tom victor wei yan yuki
brown clark davis dubois durand evans fischer garcia gomez green gonzalez hall harris hernandez hill hoffmann jackson johnson jones keller khan
klein kumar lee lefebvre lewis lopez martinez meyer miller moore moreau muller nguyen patel perez richter roberts robinson rodriguez roux ruiz
sanchez schmidt schneider schulz scott silva simon singh smith taylor torres walker wang weber white williams wilson wolf wood wright young zhang""".split()
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
DOMAINS = r"(?i)[.\x20)\]}](?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at)$"
SECRETS = r"^(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abp]|AKIA|ASIA|AIza|ya29|eyJ)"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6(?:011|4[4-9]|5))"
CALLING = r"^\+(?:1|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
LABELERS = ("regex", "gazetteer", "context", "shape", "edges")
#: Least probability of a further span.
ADDED_AT = 0.9


def may_match(t: Column, kind: str) -> Column:
    """Whether the text holds what every match of the kind needs."""
    out = F.lit(True)
    if HOLDS[kind]:
        out = F.lit(False)
        for x in HOLDS[kind]:
            out = out | F.contains(t, F.lit(x))
    return out & t.rlike("[0-9]") if kind in WITH_DIGITS else out


SPAN = "array<struct<s:bigint,e:bigint,m:string,before:string>>"
#: Matches whose positions are added up together; the results of such runs are joined once.
RUN = 512


def located(t: Column, kind: str, pattern: str) -> Column:
    """All matches in order as structs of s and e (code points, e exclusive), m and the 40 characters before.

    Positions are added up run by run, so that a text of very many matches isn't copied for each of them.
    """
    found, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(40)).alias("before"))
        return F.struct(e.cast("long").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def run(acc: Column, pairs: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), none.alias("out"))
        got = F.aggregate(pairs, start, step)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def whole(p: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: F.slice(p, k * RUN + 1, RUN))
        return F.aggregate(runs, start, run, lambda a: F.flatten(a["out"]))

    # the pairs are an element of an array, so that they are made once and not for every run
    return F.when(may_match(t, kind) & t.rlike(pattern), F.get(F.transform(F.array(pairs), whole), F.lit(0))).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.split(F.reverse(digits(m)), "")
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    each = F.transform(d, lambda x, i: F.when(i % 2 == 1, twice(F.try_to_number(x, F.lit("9")).cast("int"))).otherwise(F.try_to_number(x, F.lit("9")).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether an account number without spaces passes its check: read from the fifth place on, letters as two digits."""
    turned = F.concat(F.substring(iban, 5, 40), F.left(iban, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits(m)).between(13, 19) & luhn(F.when(F.length(m) <= 40, m).otherwise(""))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(t: Column, kind: str) -> Column:
    return F.filter(located(t, kind, BASE[kind]), lambda x: valid(kind, x["m"]))


def named(kind: str):
    """A function that puts the kind on a span. (Spark would take a second argument of it for an index.)"""
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"))


def candidates(t: Column) -> Column:
    """Further spans with their kinds; cards in other groupings have to pass their check as well."""
    out = []
    for kind, pattern in WIDE.items():
        out.append(F.transform(located(t, "wide email" if kind == "email" else kind, pattern), named(kind)))
    cards = F.filter(located(t, "card", r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"), lambda x: valid("card", x["m"]))
    out.append(F.transform(cards, named("card")))
    return F.concat(*out)


def votes(x: Column) -> list[Column]:
    """The labelers' votes on a span with kind, m and before."""
    m, before, kind = x["m"], x["before"], x["kind"]
    yes = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    n = F.length(digits(m))
    plain = F.regexp_replace(m, " ", "")
    form = (
        F.when(kind == "card", yes(n.between(13, 19) & luhn(m), 1, -1))
        .when(kind == "phone", yes(n.between(9, 15), 1, -1))
        .when(kind == "secret", yes(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(m) >= 20), 1, -1))
        .when(kind == "ssn", yes(m.rlike("^(?:000|666|9)|-00-|-0000$"), -1, 1))
        .when(kind == "iban", F.when(mod_97(plain), 1).otherwise(yes(F.length(plain).between(15, 34), 0, -1)))
        .when(kind == "name", yes(m.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"), 1, 0))
        .otherwise(1)
    )
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    tokens = F.transform(F.split(m, "[^A-Za-z]+"), F.lower)
    table = (
        F.when(kind == "name", yes(F.exists(tokens, lambda x: x.isin(*NAMES)), 1, 0))
        .when(kind == "iban", yes(F.coalesce(F.try_element_at(lengths, F.left(plain, F.lit(2))) == F.length(plain), F.lit(False)), 1, 0))
        .when(kind == "email", yes(m.rlike(DOMAINS), 1, 0))
        .when(kind == "secret", yes(m.rlike(SECRETS), 1, 0))
        .when(kind == "card", yes(digits(m).rlike(ISSUERS), 1, -1))
        .when(kind == "phone", yes(m.rlike(CALLING), 1, 0))
        .otherwise(0)
    )
    kinds_of_chars = F.size(F.array_distinct(F.split(F.substring(m, 1, 64), "")))
    return [
        form,
        table,
        F.when(before.rlike(AGAINST), -1).when(before.rlike(CUES) | m.rlike(CUES) | before.rlike(r"[=:]\x20?\"?$"), 1).otherwise(0),
        yes(kinds_of_chars >= F.when(kind == "ssn", 4).otherwise(6), 1, -1),
        yes(before.rlike(r"(?:^|[\s\"'(<])$"), 1, -1),
    ]


def length_class(m: Column) -> Column:
    return F.when(F.length(m) < 10, 0).when(F.length(m) < 16, 1).when(F.length(m) < 32, 2).otherwise(3)


def described(t: Column) -> Column:
    """Base and further spans with kind, votes and length class."""
    base = F.concat(*[F.transform(base_spans(t, k), named(k)) for k in BASE])
    mark = lambda a, is_base: F.transform(a, lambda x: x.withField("base", F.lit(is_base)))
    return F.transform(F.concat(mark(base, True), mark(candidates(t), False)), lambda x: F.struct(x["kind"].alias("kind"), x["base"].alias("base"), x["s"].alias("s"), x["e"].alias("e"), *[v.alias(n) for n, v in zip(LABELERS, votes(x), strict=True)], length_class(x["m"]).alias("size")))


#: What a labeler's vote counts for at the start of the estimation: a word against a span the most, its characters and edges the least.
TRUST = {"regex": 1.5, "gazetteer": 1.0, "context": 1.0, "shape": 0.5, "edges": 0.5}
AGAINST_TRUST = 3.5
#: What is expected of a labeler's votes before any are seen, by class, and with what share of the spans' weight.
EXPECTED = {(1, -1): 0.01, (1, 0): 0.495, (1, 1): 0.495, (0, -1): 0.5, (0, 0): 0.25, (0, 1): 0.25}
EXPECTED_SHARE = {"regex": 0.3, "gazetteer": 0.3, "context": 2.0, "shape": 0.3, "edges": 0.3}


def expect(rows: list[tuple], steps: int = 40) -> list[float]:
    """The probability that each vote pattern (kind, size, votes..., count) is personal data, by EM."""
    start = lambda r: sum(AGAINST_TRUST * v if n == "context" and v < 0 else TRUST[n] * v for n, v in zip(LABELERS, r[2:7], strict=True))
    p = [1 / (1 + math.exp(-start(r))) for r in rows]
    for _ in range(steps):
        total = sum(r[-1] for r in rows)
        share = (sum(q * r[-1] for q, r in zip(p, rows, strict=True)) + 1) / (total + 2)
        rate: list[dict] = []
        for k in range(2, 7):
            n = {key: 1 + EXPECTED_SHARE[LABELERS[k - 2]] * total * x for key, x in EXPECTED.items()}
            for q, r in zip(p, rows, strict=True):
                n[1, r[k]] += q * r[-1]
                n[0, r[k]] += (1 - q) * r[-1]
            rate.append({(c, v): n[c, v] / sum(n[c, w] for w in (-1, 0, 1)) for c, v in n})
        odds = [math.log(share / (1 - share)) + sum(math.log(f[1, r[k + 2]] / f[0, r[k + 2]]) for k, f in enumerate(rate)) for r in rows]
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return p


def features(r: tuple) -> list[str]:
    return ["bias", f"kind={r[0]}", f"size={r[1]}", *[f"{n}={v}" for n, v in zip(LABELERS, r[2:7], strict=True)]]


def train(rows: list[tuple], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier on the patterns' EM probabilities, by gradient descent."""
    w: dict[str, float] = {}
    goal, total = expect(rows), sum(r[-1] for r in rows) or 1
    feats = [features(r) for r in rows]
    for _ in range(steps):
        grad: dict[str, float] = {}
        for f, y, r in zip(feats, goal, rows, strict=True):
            z = sum(w.get(k, 0.0) for k in f)
            g = (1 / (1 + math.exp(-z)) - y) * r[-1] / total
            for k in f:
                grad[k] = grad.get(k, 0.0) + g
        for k, g in grad.items():
            w[k] = w.get(k, 0.0) - rate * (g + decay * w.get(k, 0.0))
    return w


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with base (array of kind, s, e in order of kind and start) and spans (base and added ones, likewise).

    Null text is empty and has no spans. Rows are judged one by one with one model for the table: repeated
    rows get equal spans. An empty table gives an empty table; without candidates nothing is added.
    """
    base = packed(docs).withColumn("t", text_of("row.text"))
    keys = ["kind", "size", *LABELERS]
    seen = base.select(F.explode(described(F.col("t"))).alias("x")).select("x.*").groupBy(*keys).agg(F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in seen.select(*keys, "n").collect())
    w = train(rows) if rows else {}

    def score(x: Column) -> Column:
        z = F.lit(w.get("bias", -9.0))
        for name in ("kind", "size", *LABELERS):
            for key, v in w.items():
                if key.startswith(f"{name}="):
                    z = z + F.when(x[name].cast("string") == key.split("=", 1)[1], v).otherwise(0.0)
        return z

    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda x: sum((F.when(x["kind"] == k, i).otherwise(0) for k, i in order.items()), F.lit(0))
    short = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(rank(x).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    df = base.withColumn("all", described(F.col("t"))).select("row", "all")
    own = F.filter("all", lambda x: x["base"])
    # a further span may hold a base one (an account number whose digits pass for a card), not cross it or lie in it
    added = F.filter("all", lambda x: ~x["base"] & (score(x) >= math.log(ADDED_AT / (1 - ADDED_AT))) & ~F.exists(own, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]) & ~((x["s"] <= b["s"]) & (b["e"] <= x["e"]) & (x["e"] - x["s"] > b["e"] - b["s"]))))
    return unpacked(df, docs.columns, {"base": short(own), "spans": short(F.concat(own, added))})


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
