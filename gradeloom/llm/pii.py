"""Personal data in texts, by weak supervision, with DataFrame functions only.

Exact patterns give the base spans. They take as much as they can, so a number that stands beside another one is lost with it: a
telephone number and a card number after it are one match, which is too long. Narrower shapes find such parts again, and other shapes find
other spellings. Labelers (checks, formats, context, gazetteers of cue words, neighbours) vote on all candidates, base spans or
not, by the same evidence, or abstain; expectation-maximisation estimates how reliable each is, without labels; and
a span classifier trained on the resulting probabilities decides which of the other candidates are added.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "\uE000", "\uE001"

#: The base patterns, without needless backtracking: a run of digits or name characters is tried from its begin (or the end of the
#: match before) only, as from further inside it would fail at the same place.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes of whole numbers inside of longer matches, and other spellings.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])",
    "phone": (r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])"
              r"|(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9.-])"),
}
#: Cheap necessary conditions of the patterns; of the looser ones where no base match failed.
NEEDS = {"email": r"@", "phone": r"\+"}
LOOSE_NEEDS = {"email": r"[\[(]at[\])]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": None,
               "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9.-])"}

#: Gazetteers: words that announce the kind, and words that announce other numbers.
CUES = {
    "email": "e-?mail|mail|contact|correo|courriel|kontakt|write",
    "ip": "ip|host|server|address|addr|adresse|direcci",
    "card": "card|visa|mastercard|amex|credit|tarjeta|carte|karte",
    "phone": "phone|tel|call|fax|mobile|cell|tel[eé]fono|m[oó]vil|t[eé]l[eé]phone|telefon|handy|anruf",
}
OTHER_NUMBERS = r"version|licen[sc]e|isbn|issn|order|invoice|serial|token|key|sha|md5|[$€£#]\s*$"
NEAR = 40  # code points before a candidate that are searched for cues
BESIDE = 24  # code points between neighbours

_ROUNDS = 25
_VOTES = ("check", "format", "context", "cue", "near")


def _matches(text: Column, pattern: str, need: Column) -> Column:
    """array<struct<start, stop, match>> of the leftmost non-overlapping matches, in code points; none where the need is not met."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("found"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        found = F.when(state["inside"], F.array_append(state["found"], F.struct(state["at"].alias("start"), end.alias("stop"), part.alias("match"))))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), found.otherwise(state["found"]).alias("found"))

    found = F.aggregate(parts, start, step, lambda state: state["found"])
    return F.when(need, found).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern counts."""
    count = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(count.between(16, 19), luhn(_digits(match))).otherwise(False)
    return count.between(8, 15) if kind == "phone" else F.lit(True)


def _check(kind: str, match: Column) -> Column:
    """Vote of the checks: 1, -1, or 0 without an opinion."""
    count = F.length(_digits(match))
    if kind == "card":
        return F.when(count.between(13, 19) & luhn(_digits(match)), 1).otherwise(-1)
    if kind == "ip":
        return F.when(F.contains(match, F.lit(":")) | valid("ip", match), 1).otherwise(-1)
    if kind == "phone":
        return F.when(count.between(8, 15), 1).otherwise(-1)
    return F.when(match.rlike(r"[.\])]\x20?[A-Za-z]{2,}$"), 1).otherwise(0)


def _format(kind: str, match: Column) -> Column:
    """Vote of the way it is written: first digits of issuers, usual groups, plain octets."""
    if kind == "card":
        return F.when(match.rlike("^[3-6]"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(match.rlike(r"(^|\.)0[0-9]"), -1).when(match.rlike(r"^(0|22[4-9]|2[3-5][0-9])\."), 0).otherwise(1)
    if kind == "phone":
        return F.when(match.rlike(r"\([0-9]{2,4}\)|([0-9]{2,4}[\x20.-]){2}"), 1).otherwise(0)
    return F.when(match.rlike(r"^[A-Za-z0-9]"), 1).otherwise(-1)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): base spans (kind number, start, stop) and all candidates with their votes and features, of every document."""
    text = F.col("text")
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", safe.alias("text"))
    rows = rows.select("*", *[_matches(text, BASE[k], text.rlike(NEEDS.get(k, BASE[k]))).alias(f"base_{k}") for k in KINDS])

    def good(kind: str) -> Column:
        return F.filter(F.col(f"base_{kind}"), lambda m: valid(kind, m["match"]))

    def looser(kind: str) -> Column:
        failed = F.exists(F.col(f"base_{kind}"), lambda m: ~valid(kind, m["match"])) if kind != "email" else F.lit(False)
        return _matches(text, LOOSE[kind], (failed | text.rlike(LOOSE_NEEDS[kind])) if LOOSE_NEEDS[kind] else failed)

    def place(kind: str) -> Column:
        return F.transform(F.col(f"good_{kind}"), lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))

    rows = rows.select("doc_id", "text", *[looser(k).alias(f"loose_{k}") for k in KINDS], *[good(k).alias(f"good_{k}") for k in KINDS])
    rows = rows.withColumn("base", F.concat(*map(place, KINDS)))

    def described(kind: str, strict: bool) -> Column:
        def one(m: Column) -> Column:
            before = F.lower(F.substring(text, F.greatest(m["start"] - NEAR, F.lit(0)) + 1, F.least(m["start"], F.lit(NEAR))))
            edge = F.concat(F.substring(text, m["start"], F.when(m["start"] > 0, 1).otherwise(0)), F.lit("|"), F.substring(text, m["stop"] + 1, F.lit(1)))
            free = edge.rlike(r"^[\s\"'<(\[:]?\|[\s\"'>)\],.;:!?%#&*$|]?$")
            beside = F.exists(F.col("base"), lambda b: (b["start"] != m["start"]) & (b["start"] < m["stop"] + BESIDE) & (m["start"] < b["stop"] + BESIDE))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.lit(strict).alias("strict"),
                _check(kind, m["match"]).alias("check"), _format(kind, m["match"]).alias("format"),
                F.when(~free, -1).otherwise(F.when(edge.rlike(r"^\s?\|[\s.,;:!?]?$"), 1).otherwise(0)).alias("context"),
                F.when(before.rlike(OTHER_NUMBERS), -1).when(before.rlike(rf"\b(?:{CUES[kind]})"), 1).otherwise(0).alias("cue"),
                F.when(beside, 1).otherwise(0).alias("near"),
                F.least(F.length(_digits(m["match"])), F.lit(20)).alias("digits"), F.least((m["stop"] - m["start"]) / 4, F.lit(15)).cast("int").alias("length"))

        return F.transform(F.col(f"{'good' if strict else 'loose'}_{kind}"), one)

    def apart(m: Column) -> Column:  # from all base spans
        return ~F.exists(F.col("base"), lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))

    return rows.select("doc_id", "base", F.concat(*[described(k, True) for k in KINDS], *[F.filter(described(k, False), apart) for k in KINDS]).alias("found"))


def estimate(patterns: list[tuple], rounds: int = _ROUNDS) -> dict[tuple, float]:
    """Probability that a candidate is personal data, for each (kind, *votes), from how often each pattern of votes occurs.

    One model per kind: a candidate is real or not, and each labeler that does not abstain has its own chances of voting 1 or -1 in
    either case. Rounds alternate between these chances and the probabilities, which begin with the sum of the votes. What fails its check is
    known not to be real. The table has 4 * 243 rows at most.
    """
    out: dict[tuple, float] = {}
    for kind in {p[0] for p in patterns}:
        own = [p for p in patterns if p[0] == kind]
        real = {p[:-1]: 0.01 if p[1] < 0 else min(max(0.5 + 0.15 * sum(p[1:-1]), 0.05), 0.95) for p in own}
        for _ in range(rounds):
            chance = []
            for side in (1, 0):
                weights = [(p, p[-1] * (real[p[:-1]] if side else 1 - real[p[:-1]])) for p in own]
                total = sum(w for _, w in weights)
                cast = [{v: sum(w for p, w in weights if p[1 + j] == v) + 1 for v in (-1, 1)} for j in range(len(_VOTES))]
                chance.append((math.log(total + 1), [{0: 0.0} | {v: math.log(c[v] / (c[1] + c[-1])) for v in (-1, 1)} for c in cast]))
            for p in own:
                yes, no = (prior + sum(votes[j][p[1 + j]] for j in range(len(_VOTES))) for prior, votes in chance)
                real[p[:-1]] = 0.01 if p[1] < 0 else 1 / (1 + math.exp(min(max(no - yes, -50), 50)))
        out |= real
    return out


def _features(c: Column) -> list[Column]:
    """Names of a candidate's features, each from a small set."""
    return [F.concat(F.lit(f"{n}="), c["kind"].cast("string"), F.lit(":"), c[n].cast("string")) for n in (*_VOTES, "digits", "length")]


def train(found: DataFrame) -> tuple[float, dict[str, float]]:
    """(bias, weight of each feature) of the span classifier: log odds under the estimated probabilities, smoothed.

    Two aggregations of bounded size: vote patterns for the estimate, then features weighted by the probability of their pattern.
    """
    spans = found.select(F.explode("found").alias("c"))
    key = [F.col(f"c.{n}").alias(n) for n in ("kind", *_VOTES)]
    patterns = [tuple(r) for r in spans.groupBy(*key).agg(F.count("*").alias("n")).collect()]
    if not patterns:
        return 0.0, {}
    known = estimate(patterns)
    table = found.sparkSession.createDataFrame([(*k, v) for k, v in known.items()], f"kind int, {', '.join(f'{n} int' for n in _VOTES)}, real double")
    rows = spans.select(*key, F.array(*_features(F.col("c"))).alias("names")).join(F.broadcast(table), ["kind", *_VOTES])
    sums = rows.select(F.explode("names").alias("name"), "real").groupBy("name").agg(F.sum("real").alias("yes"), F.sum(1 - F.col("real")).alias("no")).collect()
    yes, no = sum(known[p[:-1]] * p[-1] for p in patterns), sum((1 - known[p[:-1]]) * p[-1] for p in patterns)
    weights = {r["name"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in sums}
    return math.log((yes + 1) / (no + 1)), weights


def _listed(spans: Column) -> Column:
    """kind:start:end of spans in order of kind and start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document.

    Counts and the digest are of the base spans; ``spans`` lists them and those the classifier adds, which overlap no base span (looser spans of one
    kind are taken as their pattern finds them). Null and empty texts have none; repeated rows have theirs each; an empty table gives no rows.
    """
    found = stored(candidates(docs), "pii-candidates")
    bias, weights = train(found)
    held = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def score(c: Column) -> Column:
        return sum((F.coalesce(F.try_element_at(held, n), F.lit(0.0)) for n in _features(c)), F.lit(bias))

    added = F.filter("found", lambda c: ~c["strict"] & (c["check"] >= 0) & (score(c) > 0))
    rows = found.select("doc_id", "base", added.alias("added"))
    plain = F.transform("added", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                       _listed(F.concat("base", plain)).alias("spans"), F.size("added").cast("long").alias("n_added"))
