"""Personal data by weak supervision (operator 7), in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm.common import cut, table
from tracewright.llm.spans import matches

_LOCAL = "A-Za-z0-9._%+-"
#: Kinds in order: name, regular expression, what a text must contain, what a context before a span says for it.
#: The first four are fixed by the contract. A possessive quantifier, or a look back that only lets a match begin
#: where the run of its characters does (or where the last match ended), changes no match but keeps the search linear.
KINDS = [
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@", "mail|contact|write to|reach"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", "\\bip\\b|address|host|server|from|login"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", "card|visa|master|amex|credit|debit|payment|pay"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", "phone|tel|call|mobile|fax|cell|whatsapp"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", "[A-Z]{2}[0-9]{2}", "iban|account|konto|compte|cuenta|bank"),
    ("mac", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", "\\bmac\\b|hardware|device|ether"),
    ("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Señora?|Don|Doña)\.? [A-ZÀ-Ý][a-zà-ÿ]+(?: [A-ZÀ-Ý][a-zà-ÿ]+)?", "\\b(?:M|D|Prof|Sir|Herr|Frau|Señor)", "name|dear|contact|signed|patient|regards"),
    ("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+=*+", "[A-Za-z0-9+/_-]{20}", "token|secret|passw|api.?key|access.?key|auth|bearer|credential"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", "ssn|social|security"),
]
BASE = 4
#: First and last names of the gazetteer labeler.
FIRST_NAMES = "James John Robert Michael David William Richard Thomas Charles Daniel Matthew Mark Paul Steven Andrew Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Lisa Anna Emma Laura Julia Peter Hans Karl Klaus Jürgen Wolfgang Stefan Sabine Ursula Monika Petra Heike Jean Pierre Michel Philippe Alain Marie Louis Claire Nathalie Isabelle Sophie Carlos Juan Luis José Antonio Manuel Miguel Carmen Lucía Ana María Pilar Isabel Mohammed Ahmed Fatima Wei Ming Hiroshi Yuki Ivan Olga Priya Raj".split()
LAST_NAMES = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Thompson Clark Lewis Walker Young King Wright Hill Green Baker Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schulz Koch Richter Klein Wolf Neumann Martin Bernard Dubois Petit Durand Leroy Moreau Laurent Simon Lefebvre Roux Fournier García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Ruiz Díaz Moreno Álvarez Romero Torres Silva Rossi Chen Wang Li Zhang Kim Lee Nguyen Singh Kumar Patel Khan Ali Ivanov Tanaka Suzuki".split()
#: What access keys of well-known services begin with.
KEY_BEGINS = "AKIA ASIA AROA sk_ pk_ rk_ sk- ghp_ gho_ ghu_ ghs_ github_pat_ glpat- xoxa- xoxb- xoxp- xoxs- xapp- AIza ya29 eyJ SG_ npm_ pypi- hf_ dop_v1_ shpat_ sq0 EAACEdEose AGE-SECRET-KEY whsec_ lin_api_ key-".split()
#: What the gazetteer labeler looks for in a value, by kind.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|[a-z]{2})$",
    "phone": r"^\+(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[05-8][0-9]|9[0-58]|9[679][0-9])",
    "card": r"^(?:4|5[0-8]|2[2-7]|3[0-9]|6[0-9])",
    "iban": r"^(?:AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK)",
    "name": rf"(?:^|[ .])(?:{'|'.join(FIRST_NAMES + LAST_NAMES)})\b",
    "secret": rf"^(?:{'|'.join(KEY_BEGINS)})|^(?:[0-9a-fA-F]{{32}}|[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{56}}|[0-9a-fA-F]{{64}})$",
}
#: What the shape labeler asks of a value, by kind.
SHAPE = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@",
    "ip": r"^(?!0\.|127\.|255\.)[1-9]",
    "phone": r"^\+[1-9]",
    "name": r" \p{Lu}\p{Ll}{2,}",
    "secret": r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
CONTEXT = 32
VOTES = ("shape", "gazetteer", "context", "edges")
#: What the classifier sees of a span besides its votes, each as 0 to 3: its length, its share of digits, its neighbours.
TRAITS = ("size", "digits", "left", "right")
CANDIDATE = f"array<struct<kind:int,valid:int,first:int,last:int,{','.join(f'{c}:int' for c in VOTES + TRAITS)}>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The contract's condition on a match; the method's kinds have none."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^(?:{_IP_PART}\.){{3}}{_IP_PART}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 silent."""
    return F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)


def _neighbour(c: Column) -> Column:
    """0 for none, 1 white space, 2 a quote, bracket or other mark, 3 a letter or digit."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[^\p{L}\p{N}]"), 2).otherwise(3)


def _candidates(text: Column, number: int) -> Column:
    """The matches of a kind in a text with the labelers' votes; valid is 0 for those that fail the contract's condition."""
    kind, regex, _, context = KINDS[number]

    def judged(s: Column) -> Column:
        value = s["value"]
        before = F.lower(F.substring(s["before"], -CONTEXT, CONTEXT))
        left, right = F.substring(s["before"], -1, 1), F.substring(s["after"], 1, 1)
        shape = value.rlike(SHAPE[kind]) if kind in SHAPE else F.lit(True)
        known = _vote(value.rlike(GAZETTEER[kind]), ~value.rlike(GAZETTEER[kind])) if kind in GAZETTEER else F.lit(0)
        letter = F.concat(left, F.lit(" "), right).rlike(r"[\p{L}\p{N}]")
        n = s["last"] - s["first"]
        digits = F.length(_digits(value)) / n
        return F.struct(
            F.lit(number).alias("kind"), _valid(kind, value).cast("int").alias("valid"), s["first"].alias("first"), s["last"].alias("last"), _vote(shape, ~shape).alias("shape"), known.alias("gazetteer"), _vote(before.rlike(context)).alias("context"), _vote(~letter, letter).alias("edges"),
            F.when(n < 12, 0).when(n < 24, 1).when(n < 48, 2).otherwise(3).alias("size"), F.when(digits == 0, 0).when(digits < 0.34, 1).when(digits < 0.67, 2).otherwise(3).alias("digits"), _neighbour(left).alias("left"), _neighbour(right).alias("right"),
        )

    return F.transform(matches(text, F.lit(regex)), judged)


def extract(docs: DataFrame) -> DataFrame:
    """doc_id and candidates: the matches of every kind with the labelers' votes, by kind, then place."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    for k, (_, _, gate, _) in enumerate(KINDS):
        may = F.contains("text", F.lit(gate)) if gate == "@" else F.col("text").rlike(gate)
        found = found.withColumn(f"c{k}", F.when(may, _candidates(F.col("text"), k).cast(CANDIDATE)).otherwise(F.array().cast(CANDIDATE)))
    return found.select("doc_id", F.concat(*[f"c{k}" for k in range(len(KINDS))]).alias("candidates"))


#: How often a labeler is expected to vote against, not at all, and for, with the strength of BELIEF spans: for spans that
#: are not personal data, and for those that are. It says which class is which, also where a kind is rare.
EXPECTED = np.array([[0.4, 0.4, 0.2], [0.1, 0.3, 0.6]])
BELIEF = 10.0


def evidence(reliability: np.ndarray) -> np.ndarray:
    """The log odds that each vote (last axis) adds, from its chances by class (axis before it). A vote for a span never
    counts less than silence, and that never less than a vote against it."""
    odds = np.log(reliability[..., 1, :] / reliability[..., 0, :])
    no, yes = np.minimum(odds[..., 0], 0.0), np.maximum(odds[..., 2], 0.0)
    return np.stack([no, np.clip(odds[..., 1], no, yes), yes], axis=-1)


def reliabilities(kind: np.ndarray, valid: np.ndarray, votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each kind's labelers: (kind, labeler, class, vote) chances, and each row's probability.

    votes: 0 against, 1 silent, 2 for. The class of a base kind's match is known, by the contract's condition; that of
    others is estimated, from the votes' majority on.
    """
    known = kind < BASE
    p = np.where(known, valid, 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))).astype(float)
    chances = np.broadcast_to(EXPECTED, (len(KINDS), len(VOTES), 2, 3)).copy()
    for _ in range(rounds if len(kind) else 0):
        log_share = np.zeros(len(KINDS))
        for k in range(len(KINDS)):
            own = kind == k
            share = (2 + (weight * p)[own].sum()) / (4 + weight[own].sum())
            log_share[k] = np.log(share / (1 - share))
            for j in range(len(VOTES)):
                for c, q in enumerate((1 - p, p)):
                    seen = BELIEF * EXPECTED[c] + np.bincount(votes[own, j], (weight * q)[own], 3)
                    chances[k, j, c] = seen / seen.sum()
        added = evidence(chances)
        odds = log_share[kind] + sum(added[kind, j, votes[:, j]] for j in range(len(VOTES)))
        p = np.where(known, valid, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return chances, p


@dataclass
class Classifier:
    """A logistic model of a span's kind, votes and traits. votes: (kind, vote, against / silent / for); traits: (kind,
    trait, value). reliability: what expectation-maximisation found."""

    kinds: np.ndarray
    votes: np.ndarray
    traits: np.ndarray
    reliability: np.ndarray

    def probability(self, x: Column) -> Column:
        table_ = lambda a: F.array(*map(F.lit, a.ravel().tolist()))
        z = F.element_at(table_(self.kinds), x["kind"] + 1)
        for k, vote in enumerate(VOTES):
            z = z + F.element_at(table_(self.votes[:, k]), x["kind"] * 3 + x[vote] + 2)
        for k, trait in enumerate(TRAITS):
            z = z + F.element_at(table_(self.traits[:, k]), x["kind"] * 4 + x[trait] + 1)
        return 1.0 / (1.0 + F.exp(-z))


#: Ridge penalties: of what kinds and votes add, and of what traits do.
RIDGE, TRAIT_RIDGE = 0.05, 4.0


def learn(patterns: list[tuple], rounds: int = 60, steps: int = 3000) -> Classifier:
    """From rows (kind, valid, votes, traits, number of spans), of which there are at most 9 x 2 x 81 x 256.

    The labelers' reliabilities give each pattern a probability, and these train a logistic classifier of the span, in
    which a vote's weight never falls from against over silent to for. Each kind weighs as 1,000 spans at most, so that
    frequent kinds don't drown rare ones. Spans that fail the contract teach what is not personal data.
    """
    rows = np.array(patterns, float).reshape(-1, 3 + len(VOTES) + len(TRAITS))
    kind, valid, weight = rows[:, 0].astype(int), rows[:, 1], rows[:, -1]
    votes, traits = rows[:, 2 : 2 + len(VOTES)].astype(int) + 1, rows[:, 2 + len(VOTES) : -1].astype(int)
    chances, p = reliabilities(kind, valid, votes, weight, rounds)
    n, at = len(KINDS), np.arange(len(rows))
    # Weights: a kind's own; two rises for each kind and vote, which must not be negative; each kind's traits.
    rise, trait = n, n + n * len(VOTES) * 2
    x = np.zeros((len(rows), trait + n * len(TRAITS) * 4))
    x[at, kind] = 1
    for j in range(len(VOTES)):
        for v in (1, 2):
            x[at, rise + (kind * len(VOTES) + j) * 2 + v - 1] = votes[:, j] >= v
    for j in range(len(TRAITS)):
        x[at, trait + (kind * len(TRAITS) + j) * 4 + traits[:, j]] = 1
    ridge = np.where(np.arange(x.shape[1]) < trait, RIDGE, TRAIT_RIDGE)
    least = np.where((np.arange(x.shape[1]) >= rise) & (np.arange(x.shape[1]) < trait), 0.0, -np.inf)
    total = np.bincount(kind, weight, n)
    scaled = weight * np.minimum(1.0, 1000 / np.maximum(total, 1))[kind]
    w = z = np.maximum(np.zeros(x.shape[1]), least)
    step, t = 1 / (0.25 * scaled @ (x * x.sum(axis=1)[:, None]) + ridge), 1.0  # a bound of the curvature along each weight
    for _ in range(steps if len(rows) else 0):  # accelerated projected gradient
        slope = x.T @ (scaled * (1 / (1 + np.exp(-x @ z)) - p)) + ridge * z
        new = np.maximum(z - step * slope, least)
        if (new - w) @ slope > 0:  # start the acceleration anew
            t = 1.0
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    rises = w[rise:trait].reshape(n, len(VOTES), 2)
    by_vote = np.concatenate([np.zeros((n, len(VOTES), 1)), np.cumsum(rises, axis=2)], axis=2)
    return Classifier(np.round(w[:n], 6), np.round(by_vote, 6), np.round(w[trait:].reshape(n, len(TRAITS), 4), 6), chances)


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, spans (kind, first, last in code points, last exclusive) and probability of docs (doc_id, text).

    Valid spans of the base kinds are all kept; of the method's own kinds, those that the classifier gives threshold or
    more. They are ordered by kind as in KINDS, then place. Null and empty texts have none; a repeated row is
    answered again; no rows give no rows; other columns are not read. The votes of all candidates are counted by pattern,
    and only those few counts come to the driver. A text's cost grows with its length, not with its square.
    """
    found = cut(extract(docs), "personal-data")
    patterns = found.select(F.inline("candidates")).groupBy("kind", "valid", *VOTES, *TRAITS).count().collect()
    model = learn(sorted(tuple(r) for r in patterns))
    judged = F.transform(F.filter("candidates", lambda x: x["valid"] == 1), lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["last"].alias("last"), model.probability(x).alias("probability")))
    return found.select("doc_id", F.filter(judged, lambda x: (x["kind"] < BASE) | (x["probability"] >= threshold)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["first"].cast("string"), x["last"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")

    base = F.filter("spans", lambda x: x["kind"] < BASE)
    return found.select("doc_id", *map(count, range(BASE)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
