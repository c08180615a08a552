"""Personal data by weak supervision, with DataFrame functions only.

Candidates are all matches of the kinds' expressions.  Four labelers vote on
each (+1, -1, or 0 for abstaining): the format test, a gazetteer, the words
before it, and the characters around it.  Expectation-maximisation over counts
of vote patterns (a table bounded by kinds x votes x shapes, not by documents)
estimates the reliabilities of each labeler on each kind, drawn towards its
reliabilities on all kinds, and each kind's prior; its posteriors train a logistic
classifier on kind, votes, length, share of digits and what follows the span.  Spans of the base kinds that pass their
format test always stay; candidates of the added kinds stay if the classifier
gives them at least ACCEPT.

Positions come from the gaps between matches (split) and the matches themselves,
so no text is searched twice for one match.  Expressions use possessive runs and
look-behind: they equal the plain base forms and take linear time on long runs.

Defined results: null and empty texts have no spans; repeated rows get equal
results; an empty table gives an empty result and an untrained classifier; columns
to be kept must not be named ``found`` or ``pii``, others are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.shared import materialise

ACCEPT = 0.5
EM_ROUNDS = 40
#: Candidates that a labeler's reliabilities on all kinds weigh on each kind.
POOLED = 20.0
CONTEXT = 40
#: Elements that are summed one after the other; longer lists are summed in blocks of this size.
SCAN_BLOCK = 256

# Frequent given names in English, German, French and Spanish.
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Mark Paul Steven Andrew George Peter Edward Henry Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa "
    "Anna Laura Emma Alice Hans Klaus Jürgen Wolfgang Heinz Dieter Uwe Stefan Andreas Markus Jens Monika Petra Sabine Ursula Renate Heike Claudia Katrin Julia Jean Pierre Michel Alain Philippe Jacques Nicolas Louis Luc "
    "Marie Sophie Isabelle Nathalie Camille Claire Chloé Hélène Juan Carlos José Luis Miguel Javier Antonio Manuel Pablo Diego María Maria Carmen Lucía Elena Isabel Pilar Sofía Ana"
).split()

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """How candidates of a kind are found and judged; expressions are for Java's regex engine."""

    name: str
    base: bool
    needs: str  #: a cheap expression that every text with a candidate matches
    pattern: str
    listed: str  #: gazetteer: values that are known
    unlisted: str  #: gazetteer: values that are known to be something else
    before: str  #: words before it that speak for it
    against: str  #: words before it that speak against it


KINDS = (
    Kind("email", True, "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|it|nl|ch)$", r"(?i)\.(png|jpg|gif|js|css|html)$", r"mail|contact|write|from|to:|reach|kontakt|correo|courriel", r"import|package|npm|git"),
    Kind("ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         r"^([1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(0|127|255)\.", r"\bip\b|addr|host|server|login|client|from", r"version|section|chapter|\bv$|release"),
    Kind("card", True, "[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++",
         r"^(4|5[1-5]|2[2-7]|3[47]|6)", r"^0", r"card|visa|master|amex|credit|pay|karte|tarjeta|carte", r"isbn|order|invoice|serial|tracking"),
    Kind("phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]",
         r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0", r"phone|tel|call|mobile|cell|fax|anruf|llam|appel", r"sum|plus|score|delta"),
    Kind("ssn", False, "[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(000|666|9)|-00-|-0000$", r"ssn|social|security|tax", r"part|serial|model"),
    Kind("iban", False, "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
         r"^(DE|FR|ES|GB|IT|NL|CH|AT|BE|PL|PT|IE|SE|DK|NO|FI)", r"^[A-Z]{2}[0-9]{2}[A-Z]{11}", r"iban|account|bank|konto|cuenta|compte", r"serial|model|key"),
    Kind("email_words", False, r"\b(?i:at|dot)\b|\[at\]|\(at\)", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ (?:at|\[at\]|\(at\)) [A-Za-z0-9-]++ (?:dot|\[dot\]|\(dot\)) [A-Za-z]{2,12}(?![A-Za-z0-9])",
         r"(?i)[ \])](com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", r"(?i)^(look|looked|is|was|it)\b", r"mail|contact|write|reach", r"meet|arriv"),
    Kind("person", False, r"\b(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\b", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? \p{Lu}\p{L}{1,20}(?: \p{Lu}\p{L}{1,20})?",
         rf" ({'|'.join(GIVEN_NAMES)})\b", r" (The|And|Who|Pepper|Strange)\b", r"name|dear|contact|sign|by|liebe|estimad|cher", r"street|avenue|series"),
)
BASE = tuple(k.name for k in KINDS if k.base)
VOTES = ("format", "gazetteer", "context", "edges")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn test."""
    total = F.lit(0)
    back = F.lpad(digits, 19, "0")
    for i in range(19):  # from the left of 19 digits: those in odd places count double
        d = F.ascii(F.substring(back, i + 1, 1)) - 48
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10 == 0


def well_formed(kind: Column, value: Column) -> Column:
    """The format test of each kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"))
        .when(kind == "card", n.between(14, 19) & luhn(F.substring(digits, 1, 19)))
        .when(kind == "phone", n.between(10, 15))
        .when(kind == "iban", mod97(value))
        .otherwise(True)
    )


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 test: its first four characters go last, letters count from 10."""
    turned = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    step = lambda rest, c: F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97
    return F.aggregate(F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), F.ascii), F.lit(0), step) == 1


def strict(kind: Column, value: Column) -> Column:
    """A narrower form than the kind's expression, where there is one."""
    return (
        F.when(kind == "email", value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?<![.])@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}$") & ~value.contains(".."))
        .when(kind == "ip", ~value.rlike(r"(^|\.)0[0-9]"))
        .when(kind == "phone", value.rlike(r"^\+[1-9]") & ~value.rlike(r"[().-]{2}"))
        .when(kind == "ssn", value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"))
        .when(kind == "email_words", value.rlike(r"(?i) [\[(]?dot[\])]? [a-z]{2,6}$"))
        .when(kind == "person", value.rlike(r"^\p{L}+\.? \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"))
        .otherwise(True)
    )


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array, in blocks, so that long arrays take about linear time."""
    plus = lambda total, x: total + x
    zero, none = F.lit(0).cast("int"), F.array().cast("array<int>")
    scan = lambda a: F.aggregate(a, none, lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), zero) + x))
    last = F.floor((F.size(numbers) - 1) / SCAN_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(numbers, b * SCAN_BLOCK + 1, SCAN_BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, plus))
    before = F.zip_with(scan(sums), sums, lambda upto, own: upto - own)
    return F.when(F.size(numbers) > 0, F.flatten(F.zip_with(blocks, before, lambda b, start: F.transform(scan(b), lambda x: x + start)))).otherwise(none)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``found``: all candidates with place, value, format test and votes."""
    texts = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    t = F.col("__text")
    for k in KINDS:
        there = t.contains("@") if k.needs == "@" else t.rlike(k.needs)
        texts = texts.withColumns({f"__m_{k.name}": F.when(there, F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))), f"__g_{k.name}": F.when(there, F.split(t, k.pattern, -1))})
    texts = texts.drop("__text")
    ends = {f"__e_{k.name}": running_sums(F.zip_with(F.slice(f"__g_{k.name}", 1, F.size(f"__m_{k.name}")), f"__m_{k.name}", lambda g, m: F.length(g) + F.length(m))) for k in KINDS}
    texts = texts.withColumns({c: F.when(F.size(c.replace("__e_", "__m_")) > 0, e) for c, e in ends.items()})
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>")
    lists = []
    for rank, k in enumerate(KINDS):
        found = F.col(f"__m_{k.name}")
        spans = F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), placing(k.name, rank)))
        lists.append(F.coalesce(spans, empty))
    return texts.select(*keep, F.transform(F.concat(*lists), judged).alias("found"))


def placing(kind: str, rank: int):
    """The i-th candidate of a kind from its matches, gaps and ends."""
    m, g, e = (F.col(f"__{x}_{kind}") for x in "mge")

    def place(i: Column) -> Column:
        return F.struct(
            (F.element_at(e, i) - F.length(F.element_at(m, i))).alias("start"),
            F.lit(rank).alias("rank"),
            F.element_at(e, i).alias("end"),
            F.lit(kind).alias("kind"),
            F.element_at(m, i).alias("value"),
            F.lower(F.right(F.element_at(g, i), F.lit(CONTEXT))).alias("before"),
            F.left(F.element_at(g, i + 1), F.lit(1)).alias("after"),
        )

    return place


def judged(c: Column) -> Column:
    """A candidate with its votes and shape instead of its surroundings."""
    kind, value = c["kind"], c["value"]
    by_kind = lambda field, of: F.coalesce(*[F.when(kind == k.name, of.rlike(getattr(k, field))) for k in KINDS])
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    valid = well_formed(kind, value)
    glued = c["before"].rlike("[a-z0-9_]$") | c["after"].rlike("^[A-Za-z0-9_]")
    return F.struct(
        c["start"].alias("start"),
        c["rank"].alias("rank"),
        c["end"].alias("end"),
        kind.alias("kind"),
        valid.alias("valid"),
        F.when(~valid, -1).when(strict(kind, value), 1).otherwise(0).alias("format"),
        vote(by_kind("listed", value) & ~by_kind("unlisted", value), by_kind("unlisted", value)).alias("gazetteer"),
        vote(by_kind("before", c["before"]), by_kind("against", c["before"])).alias("context"),
        vote(~glued, glued).alias("edges"),
        F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("int").alias("length"),
        F.floor(4 * F.length(F.regexp_replace(value, "[^0-9]", "")) / (F.length(value) + 1)).cast("int").alias("digits"),
        F.when(c["after"] == "", 0).when(c["after"].rlike(r"^\s"), 1).when(c["after"].rlike("^[.,;:!?)]"), 2).otherwise(3).alias("next"),
    )


@dataclass
class Labels:
    """Reliabilities by expectation-maximisation and the weights of the span classifier."""

    reliability: dict[tuple[str, str, int, int], float]  #: (labeler, kind, class, vote): probability
    prior: dict[str, float]
    weights: dict[tuple[str, object], float]

    def score(self, c: Column) -> Column:
        """The classifier's probability that a candidate is personal data."""
        total = F.lit(self.weights.get(("bias", 0), 0.0))
        for (name, value), w in sorted(self.weights.items(), key=str):
            if name != "bias":
                total = total + F.when(c[name] == value, F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def learn(found: DataFrame) -> Labels:
    """Fit to the counts of vote and shape patterns of all candidates (at most kinds x 81 x 4 x 4 x 4 rows)."""
    names = ("kind", *VOTES, "length", "digits", "next")
    rows = found.select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    cells = sorted((tuple(r[n] for n in names), r["n"]) for r in rows)
    # Start from the majority of votes, then alternate reliabilities and posteriors.
    belief = [1 / (1 + math.exp(-sum(key[1:5]))) for key, _ in cells]
    reliability, prior = {}, {}
    for _ in range(EM_ROUNDS):
        for i, name in enumerate(VOTES, 1):
            for y in (0, 1):
                mass = {v: 1.0 + 0.5 * (v == 2 * y - 1) for v in (-1, 0, 1)}
                own = {k.name: dict.fromkeys(mass, 0.0) for k in KINDS}
                for (key, n), b in zip(cells, belief):
                    mass[key[i]] += n * (b if y else 1 - b)
                    own[key[0]][key[i]] += n * (b if y else 1 - b)
                pooled = {v: m / sum(mass.values()) for v, m in mass.items()}
                for kind, m in own.items():
                    reliability |= {(name, kind, y, v): (m[v] + POOLED * pooled[v]) / (sum(m.values()) + POOLED) for v in pooled}
        for k in KINDS:
            own = [(n, b) for (key, n), b in zip(cells, belief) if key[0] == k.name]
            prior[k.name] = (1 + sum(n * b for n, b in own)) / (2 + sum(n for n, _ in own))
        for j, (key, _) in enumerate(cells):
            odds = math.log(prior[key[0]] / (1 - prior[key[0]]))
            odds += sum(math.log(reliability[name, key[0], 1, key[i]] / reliability[name, key[0], 0, key[i]]) for i, name in enumerate(VOTES, 1))
            belief[j] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return Labels(reliability, prior, logistic([dict(zip(names, key)) for key, _ in cells], [n for _, n in cells], belief))


def logistic(cells: list[dict], times: list[int], belief: list[float], rounds: int = 200, rate: float = 2.0, decay: float = 1e-3) -> dict[tuple[str, object], float]:
    """Weights of one-hot features by gradient steps; cells weigh by the root of their counts, so rare kinds are learned too."""
    weights: dict[tuple[str, object], float] = {("bias", 0): 0.0}
    features = [[("bias", 0), *c.items()] for c in cells]
    heavy = [math.sqrt(n) for n in times]
    total = sum(heavy) or 1.0
    for _ in range(rounds):
        slope = {f: -decay * w for f, w in weights.items()}
        for own, n, b in zip(features, heavy, belief):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in own)))))
            for f in own:
                slope[f] = slope.get(f, 0.0) + n * (b - p) / total
        for f, s in slope.items():
            weights[f] = weights.get(f, 0.0) + rate * s
    return weights


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``pii``: spans with kind, score and whether they are of the base, by start and kind."""
    found = materialise(candidates(docs, keep), "pii-candidates")
    labels = learn(found)
    # A match that fails its kind's test (octets, Luhn, digits, mod 97) is out whatever the votes.
    scored = F.transform(F.filter("found", lambda c: c["valid"]), lambda c: F.struct(c["start"], c["rank"], c["end"], c["kind"], labels.score(c).alias("score"), c["kind"].isin(*BASE).alias("base")))
    stays = F.filter(scored, lambda s: s["base"] | (~s["kind"].isin(*BASE) & (s["score"] >= ACCEPT)))
    return found.select(*keep, F.array_sort(stays).alias("pii"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: personal data of every document."""
    spans = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, BASE), F.sha2(listed(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
