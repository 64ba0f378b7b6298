"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps the words of a clause to classes (insult, mild, violence, will, target, object, self, strike, vow,
negation, report, quote). A strike is a verb of violence with its object as an ending ("matarte"), a vow one in the future tense ("tuerai").
Behind it stands one transducer that is composed from six: threat joins "will", violence and target in the word orders of the four
languages (the target behind the verb, an object before it or before "will", an ending), a vow and its object, or
violence and "yourself"; negation and reported speech mark the insults in their scope; a last one, which reads from the
clause's end, marks insults in quotes that a report follows; target marks insults that are aimed at
someone. It puts out marks (a class and its context), never words. What is scored are the marks of a document's matched
clauses: for each kind of mark a weighted counter has an arc for the first, second, third and further one, and the arcs'
weights, which are log likelihood ratios, add up. The lexicon has no weights: a word that decides nothing alone is "mild", and only
clauses that pile up such words reach a weight.

Lexicon entries and arc weights are learned from labelled documents; a general lexicon in four
languages and prior weights stand in where labels say nothing. Learning uses a bounded sample of the
labelled rows (``MOST_LEARNED`` expected, drawn by a hash of the id, near copies counted once); all else
is bounded by the sample. Scoring reads whole texts. Null and empty texts, and texts without a matched
clause, get the base score. Repeated rows get equal scores. Without labels the fixed lexicon is used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import bound_arrow, fold, free, slices, stored, table, tidy, without
from doclens.llm.fingerprint import shingle_hashes

MOST_LEARNED = 6_000
TOXIC_AT = 0.7
#: What the evidence for a learned entry (log likelihood ratio over all documents) has beyond the logarithm of the number of
#: entries that were looked at, as one of so many is toxic by chance.
EVIDENCE = 2.0
#: Most part of a learned entry's documents that may be clean.
MOST_CLEAN = 0.1
#: Occurrences in a document that are told apart: in learning an entry, and by a counter.
TIMES, COUNTED = 3, 4
#: Letters of the shortest learned stem, and of the longest.
STEM = (3, 9)

# A general lexicon in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic worthless disgusting imbecile fool fools dumbass asshole bastard bitch cretin degenerate filth freak garbage jerk pig rat vermin arschloch idioten trottel schwachkopf dreckskerl hurensohn missgeburt wichser connard connasse crétin imbécile salaud salope abruti ordure gilipollas imbécil cabrón estúpido estúpida idiota idiotas basura escoria"
VIOLENCE = {
    "en": "kill hurt beat stab shoot burn destroy murder strangle punch crush hang",
    "de": "töten umbringen schlagen erschießen verprügeln",
    "fr": "tuer frapper égorger poignarder",
    "es": "matar golpear apuñalar",
}
WILL = "will gonna shall ll going werde werden vais allons voy vamos"
TARGETS = "you your yours u ya he him she her they them their these those everyone people du dir dein deine ihr sie tu toi ton ta votre él ella ellos usted ustedes tú"
OBJECTS = "dich euch te vous os"
SELF = "yourself yourselves"
#: Endings of an infinitive that make a strike, and a vow.
STRIKE_ENDINGS = {"es": "te lo la le los las les os"}
VOW_ENDINGS = {"fr": "ai ons", "es": "é emos"}
NEGATIONS = "not no never nor neither without isn aren wasn weren don doesn nicht kein keine nie niemals pas jamais aucun non nunca tampoco"
REPORTS = "said says say told wrote claimed called calls reported quote quoted according sagte schrieb dit écrit dijo escribió"
QUOTES = "\"“”«»„‘’'"

CLASSES = ("insult", "mild")
CONTEXTS = ("plain", "aimed", "negated", "reported")
MARKS = (*(f"{c}-{x}" for c in CLASSES for x in CONTEXTS if (c, x) != ("mild", "aimed")), "threat", "threat-reported")
#: Weights of the first, second, third and further marks where labels say nothing.
PRIOR = {"plain": (4.2, 1.0, 0.5, 0.3), "aimed": (4.8, 1.0, 0.5, 0.3), "negated": (1.0, 0.5, 0.3, 0.2), "reported": (1.0, 0.5, 0.3, 0.2)}
PRIOR_MILD = (0.0, 0.5, 1.5, 1.0)
PRIOR_THREAT = (5.0, 1.0, 0.5, 0.3)
#: Documents that a prior weight counts as.
PRIOR_ROWS = 6.0
BASE = -3.0
#: Toxic documents count as a quarter of their number in the base score: a false alarm costs more than a miss.
CAUTION = 0.25

OTHER = "*"
SIGNS = (*CLASSES, "violence", "will", "target", "object", "self", "strike", "vow", "negation", "report", "quote", *MARKS, OTHER)


class Fst:
    """Deterministic transducer: (state, sign) to (state, sign put out, weight). '*' as input stands for any sign without an arc of
    its own, None as output for the sign read. Without any arc the state is 0 again."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str | None, float]]):
        self.arcs = arcs

    def step(self, state: int, sign: str) -> tuple[int, str, float]:
        to, out, weight = self.arcs.get((state, sign)) or self.arcs.get((state, OTHER)) or (0, None, 0.0)
        return to, sign if out is None else out, weight

    def run(self, signs: Iterable[str]) -> tuple[list[str], float]:
        state, total, put = 0, 0.0, []
        for sign in signs:
            state, out, weight = self.step(state, sign)
            put.append(out)
            total += weight
        return put, total


def compose(a: Fst, b: Fst, signs: Iterable[str] = SIGNS) -> Fst:
    """The transducer that does what ``b`` does on the output of ``a``: the reachable pairs of states, with weights added."""
    arcs: dict[tuple[int, str], tuple[int, str | None, float]] = {}
    number, todo = {(0, 0): 0}, [(0, 0)]
    while todo:
        x, y = pair = todo.pop()
        for sign in signs:
            p, middle, v = a.step(x, sign)
            q, out, w = b.step(y, middle)
            if (p, q) not in number:
                number[p, q] = len(number)
                todo.append((p, q))
            arcs[number[pair], sign] = (number[p, q], out, v + w)
    return Fst(arcs)


def scope(opens: tuple[str, ...], context: str, span: int | None, classes: tuple[str, ...] = CLASSES) -> Fst:
    """Marks insults within ``span`` signs after one that opens, or to the clause's end."""
    last = span or 1
    arcs: dict[tuple[int, str], tuple[int, str | None, float]] = {(0, o): (last, None, 0.0) for o in opens} | {(0, OTHER): (0, None, 0.0)}
    for s in range(1, last + 1):
        after = s - 1 if span else s
        arcs |= {(s, o): (last, None, 0.0) for o in opens} | {(s, OTHER): (after, None, 0.0)}
        arcs |= {(s, c): (after, f"{c}-{context}", 0.0) for c in classes}
    return Fst(arcs)


#: How many signs each part of a threat waits for the next: an object for "will" or a vow, "will" for the verb, "will" and an object for the
#: verb, the verb and a vow for their target, violence without "will" for "yourself".
WAITS = {"object": 2, "will": 8, "held": 4, "struck": 3, "vow": 3, "alone": 1, "denied": 1}
#: Which part follows on a sign: "threat" ends it, "" is the start. A part that has no entry for a sign goes on waiting. Negation undoes "will".
FOLLOWS = {
    "": {"will": "will", "object": "object", "violence": "alone", "vow": "vow", "negation": "denied"},
    "object": {"will": "held", "vow": "threat", "object": "object", "violence": "alone"},
    "will": {"will": "will", "violence": "struck", "strike": "threat", "object": "held", "vow": "vow", "negation": ""},
    "held": {"will": "will", "violence": "threat", "strike": "threat", "object": "held", "vow": "threat", "negation": ""},
    "struck": {"target": "threat", "object": "threat", "self": "threat", "will": "will", "violence": "alone", "vow": "vow"},
    "vow": {"target": "threat", "object": "threat", "self": "threat", "will": "will", "violence": "alone", "vow": "vow"},
    "alone": {"self": "threat", "will": "will", "violence": "alone", "object": "object", "vow": "vow"},
    "denied": {"will": "", "vow": "", "violence": "", "object": "denied", "negation": "denied"},
}


def threat() -> Fst:
    """The parts of FOLLOWS as states, one for each sign that a part still waits."""
    states = ["", *((part, left) for part, most in WAITS.items() for left in range(most, 0, -1))]
    number = {state: i for i, state in enumerate(states)}
    number |= {(part, 0): 0 for part in WAITS}
    arcs: dict[tuple[int, str], tuple[int, str | None, float]] = {}
    for state in states:
        part, left = state or ("", 0)
        arcs[number[state], OTHER] = (number[part, left - 1] if part else 0, None, 0.0)
        for sign, to in FOLLOWS[part].items():
            arcs[number[state], sign] = (0, "threat", 0.0) if to == "threat" else (number[to, WAITS[to]] if to else 0, None, 0.0)
    return Fst(arcs)


def quoted(near: int = 4) -> Fst:
    """Read from the end: a report, at most ``near`` signs before it a quote, and the insults before that; a quoted threat is none."""
    inside = near + 1
    arcs: dict[tuple[int, str], tuple[int, str | None, float]] = {(0, OTHER): (0, None, 0.0), (inside, OTHER): (inside, None, 0.0), (inside, "quote"): (0, None, 0.0)}
    arcs |= {(s, "report"): (1, None, 0.0) for s in range(near + 1)}
    arcs |= {(s, "quote"): (inside, None, 0.0) for s in range(1, near + 1)}
    arcs |= {(s, OTHER): (s + 1 if s < near else 0, None, 0.0) for s in range(1, near + 1)}
    arcs |= {(inside, x): (inside, OTHER, 0.0) for x in ("violence", "strike", "vow")}
    return Fst(arcs | {(inside, c): (inside, f"{c}-reported", 0.0) for c in CLASSES})


#: From the clause's end, then from its start.
BACKWARD = quoted()
FORWARD_PARTS = (threat(), scope(("negation",), "negated", 3), scope(("report",), "reported", None, (*CLASSES, "threat")), scope(("target", "object"), "aimed", 6, ("insult",)), Fst({(0, c): (0, f"{c}-plain", 0.0) for c in CLASSES}))
FORWARD = FORWARD_PARTS[0]
for _part in FORWARD_PARTS[1:]:
    FORWARD = compose(FORWARD, _part)


def marks(signs: list[str]) -> list[str]:
    """The marks that the grammar puts out for a clause's signs, in order."""
    back, _ = BACKWARD.run(reversed(signs))
    out, _ = FORWARD.run(reversed(back))
    return [m for m in out if m in PLACE]


PLACE = {m: i for i, m in enumerate(MARKS)}


def counter(mark: str, weights: tuple[float, ...]) -> Fst:
    """Counts a mark up to the number of weights; each arc has its weight, further marks have none."""
    n = len(weights)
    return Fst({(s, mark): (s + 1, None, weights[s]) for s in range(n)} | {(s, OTHER): (s, None, 0.0) for s in range(n + 1)})


TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES[:6]}]|(?<!\w)[{QUOTES[6:]}]|[{QUOTES[6:]}](?!\w)")
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")


def fixed_classes() -> dict[str, str]:
    out = dict.fromkeys(QUOTES, "quote")
    for words, kind in ((TARGETS, "target"), (OBJECTS, "object"), (SELF, "self"), (WILL, "will"), (NEGATIONS, "negation"), (REPORTS, "report")):
        out |= dict.fromkeys(words.split(), kind)
    for language, verbs in VIOLENCE.items():
        for verb in verbs.split():
            out[verb] = "violence"
            out |= dict.fromkeys((verb + e for e in STRIKE_ENDINGS.get(language, "").split()), "strike")
            out |= dict.fromkeys((verb + e for e in VOW_ENDINGS.get(language, "").split()), "vow")
    return out


def prior_weights() -> dict[str, tuple[float, ...]]:
    return {m: PRIOR_THREAT if m == "threat" else PRIOR_MILD if m.startswith("mild") else PRIOR[m.split("-")[1]] for m in MARKS}


@dataclass
class Model:
    """words and stems: entry to class (a stem is the beginning of a longer word); weights: mark to its counter's arcs."""

    words: dict[str, str] = field(default_factory=lambda: dict.fromkeys(INSULTS.split(), "insult"))
    stems: dict[str, str] = field(default_factory=dict)
    weights: dict[str, tuple[float, ...]] = field(default_factory=prior_weights)
    base: float = BASE

    def __post_init__(self):
        self._seek = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state, _seek=None)

    def seek(self):
        """Automaton over all that can start a match; built once per process."""
        if self._seek is None:
            import ahocorasick

            self._seek = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *" ".join(VIOLENCE.values()).split()}:
                self._seek.add_word(w, len(w))
            self._seek.make_automaton()
            self._classes, self._sizes = fixed_classes(), sorted({len(s) for s in self.stems}, reverse=True)
        return self._seek

    def sign(self, token: str) -> str:
        """The lexicon transducer."""
        if (kind := self.words.get(token)) is not None:
            return kind
        return next((self.stems[token[:n]] for n in self._sizes if len(token) > n and token[:n] in self.stems), None) or self._classes.get(token, OTHER)

    def clauses(self, text: str) -> list[tuple[int, int, list[str]]]:
        """(start, end, marks) of every matched clause of a lower-cased text."""
        found, done = [], -1
        for end, n in self.seek().iter(text):
            at = end - n + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue
            start = max(text.rfind(c, max(done, 0), at) for c in ".!?;:\n") + 1 or max(done, 0)
            stop = CLAUSE.search(text, at)
            done = stop.start() if stop else len(text)
            if own := marks([self.sign(t) for t in TOKEN.findall(text, start, done)]):
                found.append((start, done, own))
        return found

    def counts(self, text: str) -> Counter[str]:
        """How often the matched clauses of a lower-cased text have each mark."""
        return Counter(m for _, _, own in self.clauses(text) for m in own)

    def score(self, text: str | None) -> float:
        """Probability from the counters' weights over the marks of all matched clauses."""
        logit = self.base + sum(sum(self.weights[m][:n]) for m, n in self.counts((text or "").lower()).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def features(text: str) -> Counter[str]:
    """How often a document has each word and each proper beginning of words, with a hyphen; TIMES at most."""
    out: Counter[str] = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        if len(w) > 2:
            out[w] += n
            for k in range(STEM[0], min(len(w), STEM[1])):
                out[w[:k] + "-"] += n
    return Counter({k: min(n, TIMES) for k, n in out.items()})


def evidence(t: int, c: int, base: float) -> float:
    """Log likelihood ratio of t toxic and c clean documents against the share ``base`` of toxic ones."""
    p = (t + 0.5) / (t + c + 1)
    return t * math.log(p / base) + c * math.log((1 - p) / (1 - base)) if t and p > base else 0.0


def choose(rows: list[tuple[str, int, list[int], int]], toxic: int, clean: int, least: dict[int, float]) -> dict[str, str]:
    """Entries with their classes from (feature, times, toxic documents that have it so often, number of such clean ones).

    least: evidence that a feature of so many times needs.

    Of features with the same documents the longest stands for all; a beginning with more evidence stands for
    the longer ones. Those that tell by one occurrence are insults, others mild. All with very strong evidence are taken;
    then, while toxic documents are left unexplained, the one with most evidence from those.
    """
    base = toxic / (toxic + clean)
    longest: dict[tuple, tuple[str, int]] = {}
    for name, times, docs, c in rows:
        key = (frozenset(docs), c)
        own = (-times, len(name.rstrip("-")), name.endswith("-"))
        if key not in longest or own > (-longest[key][1], len(longest[key][0].rstrip("-")), longest[key][0].endswith("-")):
            longest[key] = (name, times)
    pool = [(name, docs, c, times) for (docs, c), (name, times) in longest.items() if (c + 0.5) / (len(docs) + c + 1) <= MOST_CLEAN and evidence(len(docs), c, base) >= least[times]]
    pool.sort(key=lambda x: (-evidence(len(x[1]), x[2], base), x[3], x[0]))
    best: list[tuple[str, frozenset, int, int]] = []
    for x in pool:
        short = x[0].rstrip("-")
        # a stem says nothing more than the longer entries that have nearly all its toxic documents
        inside = [y[1] for y in best if x[0].endswith("-") and y[0].startswith(x[0][:-1])]
        told = len(x[1].intersection(frozenset().union(*inside))) >= 0.8 * len(x[1])
        if not told and not any(x[0] == y[0] or (y[0].endswith("-") and short.startswith(y[0][:-1])) for y in best):
            best.append(x)
    taken = [x for x in best if evidence(len(x[1]), x[2], base) >= 2 * least[x[3]]]
    left = set().union(*(x[1] for x in best)).difference(*(x[1] for x in taken))
    while left:
        top = max(best, key=lambda x: (evidence(len(x[1] & left), x[2], base), len(x[0]), x[0]))
        if evidence(len(top[1] & left), top[2], base) < least[top[3]]:
            break
        taken.append(top)
        left -= top[1]
    return {name: CLASSES[times > 1] for name, _, _, times in taken}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LEARNED) -> Model:
    """Fit on about ``most`` labelled documents (all, if there are fewer)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    n = known.count()
    if not n:
        return Model()
    if n > most:
        known = known.where(F.xxhash64(F.col("key").cast("string")) < int(-(1 << 63) + (1 << 64) * (most / n)))
    # the sample has a bounded number of rows of 12 bytes
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key").where("text is not null")
    rows = rows.withColumn("copy", F.coalesce(F.array_min(shingle_hashes(F.col("text"))), F.xxhash64("text")))
    firsts = rows.groupBy("copy", "y").agg(F.min("key").alias("key")).select("key").distinct()
    rows = rows.join(F.broadcast(firsts), "key", "left_semi").select(F.xxhash64("key").alias("key"), "text", "y")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            seen: list[tuple[str, int, int | None, int]] = []
            others: Counter[tuple[str, int]] = Counter()
            for k, t, y in zip(*(part.column(c).to_pylist() for c in ("key", "text", "y")), strict=True):
                own = [(name, m) for name, n in features(t).items() for m in range(1, n + 1)]
                if y:
                    seen += [(*x, k, 0) for x in own]
                else:
                    others.update(own)
            seen += [(*x, None, n) for x, n in others.items()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], kind) for i, kind in enumerate(kinds)], names=["name", "times", "doc", "clean"])

    p = (F.size("docs") + 0.5) / (F.size("docs") + F.col("clean") + 1)
    gain = F.size("docs") * F.log(p * ((toxic + clean) / toxic)) + F.col("clean") * F.log((1 - p) * ((toxic + clean) / clean))
    seen = rows.mapInArrow(tidy(spread), "name string, times int, doc long, clean long").groupBy("name", "times").agg(F.collect_set("doc").alias("docs"), F.sum("clean").alias("clean"))
    seen = stored(seen.where(F.size("docs") + F.col("clean") >= 3), "toxic-features")
    least = {r["times"]: math.log(r["n"]) + EVIDENCE for r in seen.groupBy("times").agg(F.count("*").alias("n")).collect()}
    top = seen.where((F.size("docs") >= 3) & (p > toxic / (toxic + clean)) & (gain >= min(least.values(), default=0.0)) & ((F.col("clean") + 0.5) / (F.size("docs") + F.col("clean") + 1) <= MOST_CLEAN)).collect()  # bounded by the sample
    chosen = choose([(r["name"], r["times"], r["docs"], r["clean"]) for r in top], toxic, clean, least)
    model = Model()
    model.words |= {k: x for k, x in chosen.items() if not k.endswith("-")}
    model.stems = {k[:-1]: x for k, x in chosen.items() if k.endswith("-")}
    return weigh(rows, model, toxic, clean)


def weigh(rows: DataFrame, model: Model, toxic: int, clean: int) -> Model:
    """Set the counters' weights from how many toxic and clean documents of the sample have each mark how often.

    The weight of having a mark k times is its log likelihood ratio, which may not fall as k grows; a prior stands in for PRIOR_ROWS documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter[tuple[str, int, int]] = Counter()
        for part in slices(batches):
            for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                got.update((m, min(n, COUNTED), y) for m, n in model.counts(t.lower()).items())
        kinds = (pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in got], kind) for i, kind in enumerate(kinds)), pa.array(list(got.values()), pa.int64())], names=["mark", "k", "y", "n"])

    got = {(r["mark"], r["k"], r["y"]): r["n"] for r in rows.mapInArrow(tidy(count), "mark string, k int, y int, n long").groupBy("mark", "k", "y").agg(F.sum("n").alias("n")).collect()}
    ratio = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    prior = prior_weights()
    model.base = math.log(CAUTION * (toxic + 1) / (clean + 1))
    for m in MARKS:
        # k stands for k or more from the last on
        t, c = ([got.get((m, k, y), 0) for k in range(1, COUNTED + 1)] for y in (1, 0))
        level, weights, low = 0.0, [], 0.0
        for k in range(COUNTED):
            level += prior[m][k]
            n = t[k] + c[k]
            own = (n * ratio(t[k], c[k]) + PRIOR_ROWS * level) / (n + PRIOR_ROWS)
            weights.append(max(own, low) - low)
            low = max(own, low)
        model.weights[m] = tuple(weights)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Append the score, in 0..1, to every row, in place of an input column of its name."""
    docs = without(docs, name)
    spark = docs.sparkSession
    bound_arrow(spark)
    sent = spark.sparkContext.broadcast(model)  # the entries of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sent.value.score(t) for t in part.column(text).to_pylist()], pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(tidy(run), T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(name, T.DoubleType())]))


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return learn(docs.select("doc_id", "text"), labels.where(fold("doc_id", 3) != 1))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the score of every document, learned from the folds other than 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return score(rows, _model(spark, docs, sf_dir)).drop("text").withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: toxic documents go. The columns are those of documents, so the score goes too."""
    name = free(docs, "_toxic_score")
    return score(docs, _model(spark, docs, sf_dir), name=name).where(F.col(name) < TOXIC_AT).drop(name)
