"""Toxicity by a weighted finite-state pattern grammar.

Each word of a clause becomes a symbol (insult, threat, target, speaker, negation,
reporting verb, intensifier, other). Four small transducers read the symbols from left
to right and mark insults and threats: negated, reported, strengthened, aimed at who
was named before. Three more read the outcome from right to left: aimed at who is
named after, reported by a verb at the end of the clause, and threats that are aimed
at nobody are dropped. The composition of each side is one deterministic transducer,
so a clause is read once in each direction. A matched clause counts as its strongest
match. A text's score is logistic in the number of matched clauses of each event, and
in the density of matches of each kind, with weights learnt from labelled rows around stated
prior weights. Words that hardly any but toxic labelled texts use form a class of
their own, "learnt"; for the weights, each half of the sample is read with the words
learnt from the other half, so that they are not trusted more than they deserve.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, with_columns
from .common import id_remainder, stored, text_or_empty
from .quality_classifier import labelled_sample

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled rows that are learnt from, at most.
SAMPLE = 20_000
#: A word is learnt if so many toxic sample texts have it and it is rarer in clean ones by this factor.
LEAST_TOXIC, MOST_CLEAN = 4, 0.12

INSULTS = frozenset(
    "idiot idiots moron morons stupid trash worthless pathetic disgusting clown scum loser losers dumb fool "
    "imbecile garbage vermin filth filthy pig pigs coward ugly jerk freak creep liar lunatic parasite".split()
)
THREATS = frozenset("kill hurt destroy stab shoot murder beat strangle burn hang punish".split())
SUFFERED = frozenset("killed hurt destroyed stabbed shot murdered beaten strangled burned hanged punished die".split())
TARGETS = frozenset("you your yours yourself yourselves u he him his himself she her herself they them themselves their those these people everyone".split())
SPEAKERS = frozenset("i i'm me my myself we we're us our ourselves".split())
NEGATIONS = frozenset("not no never neither nor none without hardly isn't aren't wasn't weren't don't doesn't didn't won't can't cannot".split())
REPORTS = frozenset("said says say wrote writes reported reports claimed claims quoted quotes quote alleged called stated according".split())
INTENSIFIERS = frozenset("so such very really absolute absolutely complete completely total totally utter utterly damn bloody fucking".split())

#: Words over which a negation, an intensifier, a target before and a target after reach.
NEGATION_REACH, STRENGTH_REACH, TARGET_REACH, AIM_REACH = 3, 2, 6, 3
_CLAUSE = re.compile(r"[.!?;\n]+(?=\s|$)|\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


class Transducer:
    """A deterministic finite-state transducer: arcs[state, symbol] = (next state, output symbol)."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def run(self, symbols) -> list:
        state, out, arcs = self.start, [], self.arcs
        for s in symbols:
            state, o = arcs[state, s]
            out.append(o)
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What second makes of first's output, as one transducer over the reachable pairs of states."""
    symbols = {s for _, s in first.arcs}
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        p, q = state = todo.pop()
        for s in symbols:
            if (p, s) not in first.arcs:
                continue
            p2, mid = first.arcs[p, s]
            q2, out = second.arcs[q, mid]
            arcs[state, s] = ((p2, q2), out)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return Transducer(start, arcs)


#: Symbols: o other, y target, f speaker, n negation, r report, x intensifier; a match is (kind, marks) with kind
#: i insult, l learnt word, h threat, p something suffered; marks n negated, r reported, s strengthened, then t aimed or f of the speaker.
PLAIN = ("o", "y", "f", "n", "r", "x")
KINDS = ("i", "l", "h", "p")
ENDS = ("", "t", "f")


def _matches(marks: str, ends=("",)) -> list[tuple[str, str]]:
    return [(k, "".join(m) + e) for k in KINDS for m in product(*[("", x) for x in marks]) for e in ends]


def _reach(symbol: str, most: int, before: str, mark) -> Transducer:
    """Marks matches up to `most` words after the symbol; `before` are the marks made already."""
    arcs = {}
    for left in range(most + 1):
        after = max(0, left - 1)
        for s in PLAIN:
            arcs[left, s] = (most if s == symbol else after, s)
        for m in _matches(before):
            arcs[left, m] = (after, mark(m) if left else m)
    return Transducer(0, arcs)


def negation() -> Transducer:
    """Marks matches up to NEGATION_REACH words after a negation."""
    return _reach("n", NEGATION_REACH, "", lambda m: (m[0], "n"))


def reporting() -> Transducer:
    """Marks matches after a reporting verb of the clause."""
    arcs = {}
    for told in (0, 1):
        for s in PLAIN:
            arcs[told, s] = (1 if s == "r" else told, s)
        for m in _matches("n"):
            arcs[told, m] = (told, (m[0], m[1] + "r" * told))
    return Transducer(0, arcs)


def insulting() -> Transducer:
    """Marks insults and learnt words up to STRENGTH_REACH words after an intensifier or another of them."""
    arcs = {}
    for left in range(STRENGTH_REACH + 1):
        after = max(0, left - 1)
        for s in PLAIN:
            arcs[left, s] = (STRENGTH_REACH if s == "x" else after, s)
        for m in _matches("nr"):
            strong = m[0] in "il"
            arcs[left, m] = (STRENGTH_REACH if strong else after, (m[0], m[1] + "s") if strong and left else m)
    return Transducer(0, arcs)


def targeting() -> Transducer:
    """Marks insults, and what is suffered, by who was named last up to TARGET_REACH words before: a target or the speaker."""
    arcs = {}
    for who in ("t", "f"):
        for left in range(TARGET_REACH + 1):
            after = (who, left - 1) if left > 1 else ("t", 0)
            for s in PLAIN:
                arcs[(who, left), s] = ({"y": ("t", TARGET_REACH), "f": ("f", TARGET_REACH)}.get(s, after), s)
            for m in _matches("nrs"):
                arcs[(who, left), m] = (after, (m[0], m[1] + who) if left and m[0] != "h" else m)
    return Transducer(("t", 0), arcs)


def aiming() -> Transducer:
    """From the right: marks threats and insults up to AIM_REACH words before a target."""
    arcs = {}
    for left in range(AIM_REACH + 1):
        after = max(0, left - 1)
        for s in PLAIN:
            arcs[left, s] = (AIM_REACH if s == "y" else after, s)
        for m in _matches("nrs", ENDS):
            aimed = left and (m[0] == "h" or m[1][-1:] not in ("t", "f"))
            arcs[left, m] = (after, (m[0], m[1].rstrip("tf") + "t") if aimed else m)
    return Transducer(0, arcs)


def quoting() -> Transducer:
    """From the right: marks matches of a clause whose last or last but one word is a reporting verb."""
    arcs = {}
    for place, told in product(range(3), (0, 1)):
        after = min(place + 1, 2)
        for s in PLAIN:
            arcs[(place, told), s] = ((after, 1 if s == "r" and place < 2 else told), s)
        for kind, marks in _matches("nrs", ENDS):
            more = "r" if told and "r" not in marks else ""
            arcs[(place, told), (kind, marks)] = ((after, told), (kind, "".join(x for x in "nrstf" if x in marks + more)))
    return Transducer((0, 0), arcs)


def threatening() -> Transducer:
    """Drops threats, and what is suffered, that are aimed at nobody."""
    arcs = {(0, s): (0, s) for s in PLAIN}
    for m in _matches("nrs", ENDS):
        arcs[0, m] = (0, m if m[0] in "il" or m[1].endswith("t") else "o")
    return Transducer(0, arcs)


FORWARD, BACKWARD = (negation, reporting, insulting, targeting), (aiming, quoting, threatening)


def grammar() -> tuple[Transducer, Transducer]:
    """The transducer that reads a clause, and the one that reads its outcome from the right."""
    return tuple(reduce(compose, [t() for t in side]) for side in (FORWARD, BACKWARD))


def matches_of(symbols: list, machine: tuple[Transducer, Transducer]) -> list[tuple[str, str]]:
    """The matches of a clause with their marks, in order."""
    forward, backward = machine
    out = backward.run(reversed(forward.run(symbols)))
    return [o for o in reversed(out) if isinstance(o, tuple)]


#: Matches in the order of their features, with prior weights: aimed and strengthened weighs more; negated, reported and of oneself less.
EVENTS = [m for m in _matches("nrs", ENDS) if m[0] in "il" or m[1].endswith("t")]
BASE = {"i": 2.0, "l": 0.5, "h": 2.5, "p": 2.0}
MARKS = {"n": 0.3, "r": 0.5, "s": 1.2, "t": 1.4, "f": 0.4}
EVENT_PRIOR = np.array([BASE[k] * np.prod([MARKS[x] for x in m]) for k, m in EVENTS])
PRIOR = np.append(EVENT_PRIOR, [0.5] * len(KINDS))
PRIOR_BIAS = -2.0


def classes(learnt: frozenset[str] = frozenset()) -> dict[str, object]:
    """The symbol of each listed word."""
    table: dict[str, object] = dict.fromkeys(learnt, ("l", ""))
    lists = (INTENSIFIERS, "x"), (REPORTS, "r"), (NEGATIONS, "n"), (SPEAKERS, "f"), (TARGETS, "y"), (SUFFERED, ("p", "")), (THREATS, ("h", "")), (INSULTS, ("i", ""))
    for words, s in lists:
        table |= dict.fromkeys(words, s)
    return table


def clause_counts(texts: list[bytes], table: dict[str, object], machine: tuple[Transducer, Transducer]) -> np.ndarray:
    """For each text, how many clauses have each event as their strongest match, then the grammar's matches for 100 words of each kind."""
    hot = [w for w, s in table.items() if isinstance(s, tuple)]
    trigger = re.compile("|".join(map(re.escape, sorted({w[:4] for w in hot})))) if hot else None
    index = {e: i for i, e in enumerate(EVENTS)}
    out = np.zeros((len(texts), len(PRIOR)))
    for row, raw in enumerate(texts):
        text = raw.decode("utf-8", "replace").lower()
        if trigger is None or not trigger.search(text):
            continue
        total = 0
        for clause in _CLAUSE.split(text):
            symbols = [table.get(w.replace("’", "'"), "o") for w in _WORD.findall(clause)]
            total += len(symbols)
            if any(isinstance(s, tuple) for s in symbols) and (found := matches_of(symbols, machine)):
                best = max((index[m] for m in found), key=lambda i: (EVENT_PRIOR[i], -i))
                out[row, best] += 1
                for kind, _ in found:
                    out[row, len(EVENTS) + KINDS.index(kind)] += 1
        out[row, len(EVENTS) :] *= 100 / max(total, 1)
    return out


def fit(counts: np.ndarray, label: np.ndarray, steps: int = 300, pull: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias: logistic regression on log(1 + count), pulled to the prior, by damped Newton steps."""
    x = np.column_stack([np.log1p(counts), np.ones(len(counts))])
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - label) + pull * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    # More matched clauses never lower a score.
    w[:-1] = np.maximum(w[:-1], 0.0)
    return w


def learnt_words(sample: DataFrame) -> list[frozenset[str]]:
    """Words that many toxic texts and few clean ones have: in the sample's even half, its odd half, and all of it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"\p{L}{3,}"), F.lit(0)))
    half = F.col("label").cast("long").alias("label"), F.col("half")
    toxic, clean = F.col("label"), 1 - F.col("label")
    parts = [F.col("half") == 0, F.col("half") == 1, F.lit(True)]

    def sums(df):
        return df.agg(*[F.coalesce(F.sum(F.when(p, v)), F.lit(0)).alias(f"{n}{i}") for i, p in enumerate(parts) for n, v in (("t", toxic), ("c", clean))])

    total = sums(sample.select(*half)).first()
    seen = sums(sample.select(*half, F.explode(words).alias("word")).groupBy("word"))
    fine = [
        (F.col(f"t{i}") >= LEAST_TOXIC) & (F.col(f"c{i}") * total[f"t{i}"] <= MOST_CLEAN * F.col(f"t{i}") * total[f"c{i}"]) for i in range(3)
    ]
    # The sample is bounded, and each word takes LEAST_TOXIC of its texts, so the driver gets a bounded list.
    rows = seen.select("word", *[f.alias(f"f{i}") for i, f in enumerate(fine)]).filter("f0 or f1 or f2").collect()
    return [frozenset(r["word"] for r in rows if r[f"f{i}"]) for i in range(3)]


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts match nothing and get the score of the bias; without labelled
    rows the prior weights hold. A text of any length is read whole, clause by clause.
    Rows that repeat a doc_id are scored one by one; of contradicting labels of one
    doc_id the larger holds; equal texts get equal scores. An empty table gives no
    rows; other columns are not read.
    """
    chosen = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, sample, "toxic-")
    chosen = stored(chosen.withColumn("half", F.pmod(F.xxhash64("digest"), F.lit(2)).cast("int")))
    even, odd, every = map(classes, learnt_words(chosen))
    table, machine = every, grammar()

    def count(batches):
        for batch, texts in blocks(batches):
            half = batch.column(batch.schema.get_field_index("half")).to_numpy()
            c = np.where((half == 0)[:, None], clause_counts(texts, odd, machine), clause_counts(texts, even, machine))
            yield with_columns(batch, ["label"], {"counts": pa.array(c.tolist(), pa.list_(pa.float64()))})

    counted = chosen.select(F.col("label").cast("int").alias("label"), "half", "text").mapInArrow(count, "label int, counts array<double>")
    # Equal count vectors are summed up first: the driver gets each distinct one once.
    groups = counted.groupBy("counts", "label").count().collect()
    weights = np.append(PRIOR, PRIOR_BIAS)
    if groups:
        x = np.repeat(np.array([r["counts"] for r in groups]), [r["count"] for r in groups], axis=0)
        y = np.repeat([r["label"] for r in groups], [r["count"] for r in groups])
        weights = fit(x, y)

    def scan(batches):
        for batch, texts in blocks(batches):
            s = np.log1p(clause_counts(texts, table, machine)) @ weights[:-1] + weights[-1]
            yield with_columns(batch, ["doc_id"], {"score": pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
