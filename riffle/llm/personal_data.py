"""Personal data in texts: fixed patterns, and credentials found by weak supervision. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java patterns. A look-behind (or the end of the match before) and possessive loops keep them linear in a long word.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these holds no match.
NEEDED = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "+"}
#: Texts that may be a credential: long and with a digit, as a word or as a quoted or assigned value.
CANDIDATE = r"(?:(?<![A-Za-z0-9_/+-])|\G)(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+"
#: Gazetteer of words before a credential.
CREDENTIAL_WORDS = ["token", "password", "passwd", "pwd", "secret", "key", "apikey", "auth", "bearer", "credential"]
#: What is assigned to such a word is a candidate whatever its length and characters: quoted to the end of the quotes, else
#: up to a space, without the punctuation of the sentence.
_ASSIGNED = rf"(?i:{'|'.join(CREDENTIAL_WORDS)})[\"']?\s{{0,2}}[:=]{{1,2}}\s{{0,2}}"
NAMED = (rf"(?<=[:=\s\"'])(?:(?<={_ASSIGNED}\")[^\"\r\n]++(?=\")|(?<={_ASSIGNED}')[^'\r\n]++(?=')"
         rf"|(?<={_ASSIGNED}[\"']?)[^\s\"':=]\S*(?<![.,;)\]}}>\"']))")
LABELERS = ["regex", "gazetteer", "context", "mixture"]
FEATURES = ["upper", "lower", "mixed_case", "hex", "no_letter", "long", "very_long", "short", "plain_word", "prefix", "named", "assigned"]
PLAIN_WORD = "^[A-Z]?[a-z]+$"
#: Pieces whose lengths are added up in one go.
STEP = 256
EM_ROUNDS, FIT_ROUNDS, RIDGE = 50, 30, 1.0


def starts(lengths: Column) -> Column:
    """Sum of all entries before each one. Sums of blocks first, so that the time is far from quadratic."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda b: total(F.slice(lengths, b * STEP + 1, F.lit(STEP))))
    return let(blocks, lambda sums: F.transform(lengths, lambda _, i: total(F.slice(sums, F.lit(1), F.floor(i / STEP).cast("int"))) + total(
        F.slice(lengths, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


SPAN = "array<struct<start: int, end: int, value: string, before: string, after: string>>"


def matches(text: Column, pattern: str, needed: Column) -> Column:
    """Leftmost non-overlapping matches: places in code points (end exclusive), text, and 24 characters to both sides."""
    none = F.array().cast(SPAN)

    def spans(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            # Bound once: starts() reads the lengths again for every match.
            lengths = F.transform(found, lambda x, i: F.length(F.get(pieces, i)) + F.length(x))
            return let(let(lengths, starts), lambda begin: F.transform(found, lambda x, i: F.struct(
                (F.get(begin, i) + F.length(F.get(pieces, i))).alias("start"), (F.get(begin, i) + F.length(F.get(pieces, i)) + F.length(x)).alias("end"),
                x.alias("value"), F.right(F.get(pieces, i), F.lit(24)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(24)).alias("after"))))

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), placed))

    return F.when(needed, let(F.regexp_extract_all(text, F.lit(pattern), 0), spans)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum of cards."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = 2 * digit
        return total + F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{BYTE}[.]{BYTE}[.]{BYTE}[.]{BYTE}$")
    if kind == "card":
        size = F.length(digits(value))
        return F.when(size.between(13, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    needed = F.contains(text, F.lit(NEEDED[kind])) if kind in ("email", "phone") else text.rlike(NEEDED[kind])
    return F.filter(matches(text, PATTERNS[kind], needed), lambda x: passes(kind, x["value"]))


def candidates(text: Column) -> Column:
    """Long words with a digit, and whatever is assigned to a credential word; the latter stands for the long words in it."""
    def merged(named: Column) -> Column:
        inside = lambda x: F.exists(named, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))
        return F.array_sort(F.concat(named, F.filter(matches(text, CANDIDATE, text.rlike("[0-9]")), lambda x: ~inside(x))))

    return let(matches(text, NAMED, text.rlike(_ASSIGNED)), merged)


def votes(span: Column) -> dict[str, Column]:
    """What each labeler says of a candidate: 1 a credential, 0 none, -1 nothing."""
    value, before, after = span["value"], span["before"], span["after"]
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    number = F.length(digits(value))
    words = "|".join(CREDENTIAL_WORDS)
    return {
        "regex": F.when(value.rlike("^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_/+-]{20,})$"), 1).when(letters == 0, 0).otherwise(-1),
        "gazetteer": F.when(before.rlike(f"(?i)(?:{words})[\\s=:\"']{{1,6}}$"), 1).otherwise(-1),
        "context": F.when(before.rlike("[=:]\\s?[\"']?$"), 1).when(before.rlike("\\w[,.]?\\s$") & after.rlike("^\\s?\\w"), -1).otherwise(0),
        "mixture": F.when((letters >= 3) & (number >= 3), 1).when((letters == 0) | value.rlike(PLAIN_WORD), 0).otherwise(-1),
    }


def features(span: Column) -> dict[str, Column]:
    value = span["value"]
    upper, lower = value.rlike("[A-Z]"), value.rlike("[a-z]")
    return {
        "upper": upper & ~lower, "lower": lower & ~upper, "mixed_case": upper & lower, "hex": value.rlike("^[0-9a-f]+$"),
        "no_letter": ~value.rlike("[A-Za-z]"), "long": F.length(value) >= 20, "very_long": F.length(value) >= 32,
        "short": F.length(value) < 16, "plain_word": value.rlike(PLAIN_WORD),
        "prefix": value.rlike("^[A-Z]{4}[0-9A-Z]{16}$"), "named": votes(span)["gazetteer"] == 1, "assigned": votes(span)["context"] == 1,
    }


@dataclass
class SpanClassifier:
    """``reliability``: for each labeler P(vote 1) of a credential and of other text; the weights of the final classifier."""

    reliability: dict[str, tuple[float, float]]
    prior: float
    weights: dict[str, float]
    bias: float

    def accepts(self, span: Column) -> Column:
        logit = F.lit(self.bias)
        for name, column in features(span).items():
            logit = logit + F.when(column, self.weights[name]).otherwise(0.0)
        return logit >= 0


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]]) -> tuple[list[tuple[float, float]], float, list[float]]:
    """Reliabilities, prior and posteriors from (votes, count). Starts from the majority; a labeler is never trusted fully."""
    n = len(LABELERS)
    post = [min(0.95, max(0.05, (1 + sum(v == 1 for v in vote)) / (2 + sum(v >= 0 for v in vote)))) for vote, _ in patterns]
    rates, prior = [(0.8, 0.2)] * n, 0.5
    for _ in range(EM_ROUNDS):
        prior = (1 + sum(p * c for p, (_, c) in zip(post, patterns))) / (2 + sum(c for _, c in patterns))
        rates = []
        for k in range(n):
            cast = [(p, vote[k], c) for p, (vote, c) in zip(post, patterns) if vote[k] >= 0]
            yes, no = sum(p * c for p, _, c in cast), sum((1 - p) * c for p, _, c in cast)
            # As if each labeler had been seen right 8 and wrong 2 times in either class.
            rates.append(((8 + sum(p * c for p, v, c in cast if v == 1)) / (10 + yes), (2 + sum((1 - p) * c for p, v, c in cast if v == 1)) / (10 + no)))
        post = []
        for vote, _ in patterns:
            logit = log(prior / (1 - prior))
            for (a, b), v in zip(rates, vote):
                logit += log(a / b) if v == 1 else log((1 - a) / (1 - b)) if v == 0 else 0.0
            post.append(1 / (1 + exp(-max(-30.0, min(30.0, logit)))))
    return rates, prior, post


def fit_weights(rows: list[tuple[tuple[bool, ...], float, float]]) -> list[float]:
    """Logistic regression of (features, target share, count) with a ridge, by coordinate-wise Newton steps; bias last."""
    weights = [0.0] * (len(FEATURES) + 1)
    for _ in range(FIT_ROUNDS):
        for k in range(len(weights)):
            slope, bend = RIDGE * weights[k] * (k < len(FEATURES)), RIDGE
            for x, y, c in rows:
                if k == len(FEATURES) or x[k]:
                    p = 1 / (1 + exp(-max(-30.0, min(30.0, weights[-1] + sum(w for w, on in zip(weights, x) if on)))))
                    slope += c * (p - y)
                    bend += c * max(p * (1 - p), 1e-3)
            weights[k] -= slope / bend
    return weights


def fit(docs: DataFrame) -> SpanClassifier:
    """Classifier of credential candidates from all texts of ``docs``, without a label.

    The labelers vote on every candidate. Votes and features are counted in Spark; what reaches the driver are the
    counts of the combinations that occur, at most ``3 ** 4 * 2 ** 12`` rows whatever the input. From the vote
    counts expectation-maximisation estimates how reliable each labeler is, and the posteriors train the
    classifier. Without any candidate it accepts nothing.
    """
    spans = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("span"))
    named = spans.select(*(c.cast("int").alias(f"vote_{k}") for k, c in votes(F.col("span")).items()), *(c.alias(k) for k, c in features(F.col("span")).items()))
    rows = named.groupBy(*named.columns).agg(F.count("*").alias("n")).orderBy(*named.columns).collect()
    if not rows:
        return SpanClassifier({k: (0.8, 0.2) for k in LABELERS}, 0.5, dict.fromkeys(FEATURES, 0.0), -1.0)
    counts: dict[tuple[int, ...], float] = {}
    for r in rows:
        vote = tuple(r[f"vote_{k}"] for k in LABELERS)
        counts[vote] = counts.get(vote, 0.0) + r["n"]
    patterns = sorted(counts.items())
    rates, prior, post = expectation_maximisation(patterns)
    belief = {vote: p for (vote, _), p in zip(patterns, post)}
    weights = fit_weights([(tuple(r[k] for k in FEATURES), belief[tuple(r[f"vote_{k}"] for k in LABELERS)], float(r["n"])) for r in rows])
    return SpanClassifier(dict(zip(LABELERS, rates)), prior, dict(zip(FEATURES, weights)), weights[-1])


def find(docs: DataFrame, classifier: SpanClassifier) -> DataFrame:
    """Adds an array of (``start``, ``end``, ``value``, ``before``, ``after``) for each kind: ``email``, ``ip``, ``card``, ``phone``, ``secret``.

    The first four follow their patterns and checks and do not depend on the classifier; ``secret`` are the
    candidates it accepts, which may overlap others. A null or empty text has no span. Every row stays, repeated rows
    too, with its other columns; columns named like the kinds are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*PATTERNS, "secret")]
    return docs.select(*kept, *(base_spans(text, kind).alias(kind) for kind in PATTERNS),
                       F.filter(candidates(text), classifier.accepts).alias("secret"))


def written(kind: str) -> Column:
    """Spans of a kind as ``kind:start:end``."""
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def redacted(found: DataFrame) -> DataFrame:
    """``text`` of the result of :func:`find` with each span replaced by its kind in brackets, and without the span columns.

    Overlapping spans become one, named after the kind of the first. A text without a span stays as it is, also null.
    """
    kinds = [*PATTERNS, "secret"]

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    everything = F.array_sort(F.concat(*map(named, kinds)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), held["at"] + 1, x["start"] - held["at"])
        return F.when(x["start"] < held["at"], F.struct(F.greatest(held["at"], x["end"]).alias("at"), held["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(held["out"], F.array(gap, F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")))

    def joined(held: Column) -> Column:
        return F.concat(F.array_join(held["out"], ""), F.substring(F.col("text"), held["at"] + 1, F.length("text") - held["at"]))

    any_span = F.greatest(*(F.size(k) for k in kinds)) > 0
    text = F.when(any_span, F.aggregate(everything, empty, step, joined)).otherwise(F.col("text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in found.columns if c not in kinds))
