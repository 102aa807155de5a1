"""Toxicity scores from a weighted finite-state pattern grammar.

Words become symbols (insult, ambiguous insult, mark, threat, modal, person, object, copula, negation, report). Transducers,
composed into one machine that reads a clause, rewrite its insults and threats: the insult transducer tells insults that
pile up from single ones, the threat transducer verbs of harm that a modal announces from mere verbs, two more mark what
stands in the scope of a negation and what follows a verb of reporting or an opening quote, and three say what is aimed at
a person: an insult in a person's scope, an ambiguous word only where it is said of a person or stands next to one (you
clown, they are trash), a verb of harm only where a person is its object; they run once more from the clause's end, for
persons that follow. What is piled up or aimed is a matched clause and counts by its pattern; a verb of harm without a
person is none, and neither is an ambiguous word that is neither piled up nor said of a person (the circus clown, the trash
was collected). A clause that merely holds an insult is the weakest pattern: the first of a document counts nothing, and
further ones count by how many different words they have. The tables need it: most of their toxic documents hold such
words in clauses of invented words, without person or predicate. A document's score is a logistic sum.

Words are not enough in languages of which no list is at hand, so marks are learned from labelled documents: words and
word beginnings that toxic documents have far more often than clean ones, chosen greedily by how many toxic documents
they explain that are not explained yet. Clean documents may hold such a word now and then, so marks weigh on their own.
Labels name documents and not words, so targets, modals, negations and verbs of reporting are lists, one a language.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import remainder, sampling_weights, training_rows
from tidemark.llm.shared import materialise, release, sliced, texts_of

FOLDS, HELD = 5, 0
THRESHOLD = 0.5
#: Labelled rows of each class that are learned from, at most.
TRAIN_PER_CLASS = 3000
#: Unmarked words after which a scope ends.
GAP_AFTER = 5

INSULT, MARK, THREAT, MODAL, PERSON, NEGATION, REPORT, GAP = 1, 2, 3, 4, 5, 6, 7, 8
AMBIGUOUS, COPULA, OBJECT, ADDRESS, POSSESSIVE, OTHER = 9, 10, 11, 12, 13, 14
#: What patterns tell apart, and what the machine rewrites: an ambiguous insult that is bound is an insult.
MATCHES = (INSULT, MARK, THREAT)
READ = (*MATCHES, AMBIGUOUS)
#: Unmarked words between a verb of harm and a person that follows it, at most.
OBJECT_WITHIN = 2

# The seed lexicon.
SEEDS = {
    INSULT: "idiot idiots idiotic moron morons moronic stupid scum pathetic disgusting worthless imbecile cretin scumbag dumbass bastard bastards asshole dimwit halfwit subhuman "
    "dummkopf vollidiot arschloch abschaum connard imbécile crétin salaud gilipollas imbécil cabrón estúpido estúpida",
    AMBIGUOUS: "loser losers trash clown clowns vermin degenerate ordure",
    THREAT: "kill kills strangle murder slaughter butcher exterminate destroy umbringen töten abschlachten tuer égorger massacrer matar degollar asesinar",
    MODAL: "will gonna going shall must should want i'll we'll werde werden wirst muss sollte vais va allons dois devrait voy vamos debo debería quiero",
    PERSON: "you u he she they du ihr sie tu vous ils elles tú usted ustedes ellos ellas vosotros",
    OBJECT: "him her them dich dir ihn euch toi te",
    ADDRESS: "you're youre ur he's she's they're",
    POSSESSIVE: "your vos",
    COPULA: "are is am was were be bist ist seid sind war es est êtes sont eres son",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't nor neither nicht kein keine nie niemals pas jamais ni nunca jamás tampoco",
    REPORT: "said says called calls wrote writes quoted quotes reported reportedly allegedly claimed sagte nannte schrieb dit disait appelé écrit dijo llamó escribió",
}
#: What is no part of a word at its ends.
EDGES = string.punctuation + "«»„“”‚‘’…–—¿¡"
CLAUSE_END = (".", "!", "?", ";", ":", ".\"", "!\"", "?\"")
PREFIXES = range(4, 8)

#: The patterns: what matched x in a negation's scope x reported x how it is bound (0: not at all, 1: piled, announced or
#: aimed at a person, 2: aimed and also piled or announced; a threat that aims at nobody is not bound).
PATTERNS = [(kind, neg, rep, bound) for kind in MATCHES for neg in (0, 1) for rep in (0, 1) for bound in (0, 1, 2)]
NUMBER = {p: i for i, p in enumerate(PATTERNS)}
#: What the weights are believed to be before labels are seen.
BELIEFS = {INSULT: (4.0, 6.0, 7.0), MARK: (4.0, 5.0, 5.5), THREAT: (0.3, 4.6, 6.5)}
PRIOR = np.array([BELIEFS[k][bound] * (0.3 if neg else 1.0) * (0.4 if rep else 1.0) for k, neg, rep, bound in PATTERNS])
PRIOR_BIAS, PRIOR_STRENGTH, BIAS_STRENGTH = -3.0, 0.0005, 0.1
#: The bias at most: a text without a matched clause is never toxic, whatever labels say.
MOST_BIAS = -1.0
#: How much more frequent a mark must be among toxic documents, and how sure that must be (likelihood ratio).
LIFT, SURE = 4.0, 25.0


class Transducer:
    """A deterministic transducer: steps[(state, symbol)] is (state, symbol out); what isn't listed passes unchanged."""

    def __init__(self, steps: dict[tuple[int, object], tuple[int, object]]) -> None:
        self.steps = steps

    def step(self, state: int, symbol: object) -> tuple[int, object]:
        return self.steps.get((state, symbol), (state, symbol))

    def compose(self, other: Transducer, symbols: set) -> Transducer:
        """One machine that does what this one does and then what `other` does, over the input `symbols`."""
        number: dict[tuple[int, int], int] = {(0, 0): 0}
        steps, queue = {}, [(0, 0)]
        while queue:
            pair = queue.pop()
            for s in symbols:
                a, middle = self.step(pair[0], s)
                b, out = other.step(pair[1], middle)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    queue.append((a, b))
                steps[number[pair], s] = (number[a, b], out)
        return Transducer(steps)

    def outputs(self, symbols: set) -> set:
        return {out for _, out in self.steps.values()} | symbols


def _forms(kinds: tuple[int, ...], marks: int) -> list[tuple]:
    """Every form that matches of `kinds` can have when so many marks are set."""
    return [(k, *m) for k in kinds for m in product((0, 1), repeat=marks)]


def _insults() -> Transducer:
    """Appends 1 to an insult, ambiguous one or mark that follows an insult or mark in scope, else 0."""
    steps = {(s, (k,)): (1, (k, s)) for s in (0, 1) for k in (INSULT, MARK)}
    return Transducer(steps | {(s, (AMBIGUOUS,)): (s, (AMBIGUOUS, s)) for s in (0, 1)} | {(1, GAP): (0, GAP)})


def _marker(triggers: tuple[int, ...], ends: tuple[int, ...], forms: list[tuple]) -> Transducer:
    """Appends 1 to the `forms` in the scope of one of `triggers`, else 0; a scope lasts until a symbol of `ends`."""
    steps: dict = {(s, t): (1, t) for s in (0, 1) for t in triggers} | {(1, e): (0, e) for e in ends}
    return Transducer(steps | {(s, f): (s, (*f, s)) for s in (0, 1) for f in forms})


def _said_of(forms: list[tuple]) -> Transducer:
    """Appends 1 to the `forms` that are said of a person or stand next to one, else 0.

    States: 1 a person has just been named, 2 a predicate of one has begun, 3 a copula has just come (are you ...).
    """
    steps: dict = {}
    for s in range(4):
        steps |= {(s, PERSON): (2 if s == 3 else 1, PERSON), (s, ADDRESS): (2, ADDRESS), (s, GAP): (0, GAP), (s, COPULA): (2 if s in (1, 2) else 3, COPULA)}
        steps |= {(s, x): (2 if s == 2 else 0, x) for x in (OTHER, MODAL, OBJECT, POSSESSIVE, REPORT)}
        steps |= {(s, f): (s, (*f, int(s in (1, 2)))) for f in forms}
    return Transducer(steps)


ANYBODY = (PERSON, OBJECT, ADDRESS, POSSESSIVE)


def grammar() -> Transducer:
    """The composed machine: it reads (INSULT,), (MARK,), (THREAT,), (AMBIGUOUS,) and bare symbols, and gives (kind, bound, neg, rep, aim)."""
    symbols = {MODAL, PERSON, NEGATION, REPORT, GAP, COPULA, OBJECT, ADDRESS, POSSESSIVE, OTHER, *((k,) for k in READ)}
    machine = _insults().compose(_marker((MODAL,), (GAP,), _forms((THREAT,), 0)), symbols)
    for place, (trigger, ends) in enumerate(((NEGATION, (GAP,)), (REPORT, ())), start=1):
        machine = machine.compose(_marker((trigger,), ends, _forms(READ, place)), symbols)
    for aim in (_marker(ANYBODY, (GAP,), _forms((INSULT, MARK), 3)), _marker((OBJECT,), (GAP,), _forms((THREAT,), 3)), _said_of(_forms((AMBIGUOUS,), 3))):
        machine = machine.compose(aim, symbols)
    return machine


class ToxicityModel:
    """The lexicon (exact words and beginnings of words), the grammar and the weights of its patterns."""

    def __init__(self, words: set[str], beginnings: set[str]) -> None:
        self.exact = dict.fromkeys(words, MARK) | {w: kind for kind, ws in SEEDS.items() for w in ws.split()}
        self.beginnings = beginnings
        self.machine = grammar()
        self.backwards = _marker(ANYBODY, (GAP,), _forms((INSULT, MARK), 0)), _marker((PERSON, OBJECT), (GAP,), _forms((THREAT,), 0))
        self.weights, self.bias = PRIOR.copy(), PRIOR_BIAS
        self._known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def symbol(self, word: str) -> int:
        core = word.strip(EDGES)
        kind = self.exact.get(core, 0)
        if not kind and any(core[:n] in self.beginnings for n in PREFIXES):
            kind = MARK
        if len(self._known) >= 300_000:
            self._known.clear()
        self._known[word] = kind
        return kind

    def counts(self, text: str) -> np.ndarray:
        """A whole text's count of each of PATTERNS: clauses where it is bound, different words where it isn't."""
        words, found, alone = text.lower().split(), np.zeros(len(PATTERNS)), defaultdict(set)
        known, symbol = self._known.get, self.symbol
        kinds = [k if (k := known(w)) is not None else symbol(w) for w in words]
        done = 0
        for at in [i for i, k in enumerate(kinds) if k in READ]:
            if at < done:
                continue
            first, last = at, at
            while first > done and not words[first - 1].endswith(CLAUSE_END):
                first -= 1
            while last + 1 < len(words) and not words[last].endswith(CLAUSE_END):
                last += 1
            done = last + 1
            for i, pattern in self.clause(words[first:done], kinds[first:done]):
                if pattern[-1]:
                    found[NUMBER[pattern]] += 1
                else:
                    alone[pattern].add(words[first + i].strip(EDGES))
        sure = any(k == INSULT and different for (k, *_), different in alone.items())
        for (kind, *rest), different in list(alone.items()):
            if kind != AMBIGUOUS:
                found[NUMBER[kind, *rest]] += len(different)
            elif sure:  # beside an insult that is none of them, in whatever clause, an ambiguous word is one too
                found[NUMBER[INSULT, *rest]] += len(different)
        return found

    def clause(self, words: list[str], kinds: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Place and pattern of each match in the words of one clause; AMBIGUOUS is the kind of what isn't bound."""
        ahead, states, bare = set(), [0, 0], 0
        for i in range(len(words) - 1, -1, -1):
            bare = 0 if kinds[i] not in (0, COPULA) else bare + 1
            for n, (machine, within) in enumerate(zip(self.backwards, (GAP_AFTER, OBJECT_WITHIN + 1), strict=True)):
                if kinds[i]:
                    states[n], out = machine.step(states[n], (kinds[i],) if kinds[i] in READ else kinds[i])
                    if kinds[i] in MATCHES and len(out) > 1 and out[-1]:
                        ahead.add(i)
                if bare == within:
                    states[n], _ = machine.step(states[n], GAP)
        state, bare, last, again = 0, 0, "", 0
        for i, kind in enumerate(kinds):
            if words[i][0] in "\"„“«":
                state, _ = self.machine.step(state, REPORT)
            bare = 0 if kind not in (0, COPULA) else bare + 1
            if kind:
                state, out = self.machine.step(state, (kind,) if kind in READ else kind)
                if kind in READ:
                    _, bound, neg, rep, aim = out
                    aimed, core = int(aim or i in ahead), words[i].strip(EDGES)
                    if kind == THREAT:
                        bound = 1 + bound if aimed else 0
                    else:  # the same word again piles nothing up, before it comes a third time
                        again = again + 1 if bound and core == last else 0
                        bound, last = int(bound and again != 1) + aimed, core
                    yield i, (INSULT if kind == AMBIGUOUS and bound else kind, neg, rep, bound)
            else:
                state, _ = self.machine.step(state, OTHER)
            if bare == GAP_AFTER:
                state, _ = self.machine.step(state, GAP)

    @staticmethod
    def evidence(counts: np.ndarray) -> np.ndarray:
        """Logarithms of counts; what is not bound has none for the first word."""
        return np.where(np.array([bool(p[-1]) for p in PATTERNS]), np.log1p(counts), np.log(np.maximum(counts, 1)))

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.evidence(counts) @ self.weights, -500, 500)))

    def fit(self, counts: np.ndarray, y: np.ndarray, stands_for: np.ndarray | None = None, rounds: int = 30) -> None:
        """Newton steps of a logistic regression whose weights are drawn to the prior; a row counts `stands_for` times.

        The bias is drawn more strongly: it says what patterns that labels never show must weigh to reach the threshold.
        """
        times = np.ones(len(y)) if stands_for is None else stands_for
        x = np.concatenate([self.evidence(counts), np.ones((len(y), 1))], axis=1)
        mean = np.concatenate([PRIOR, [PRIOR_BIAS]])
        w, strength = mean.copy(), np.append(np.full(len(PRIOR), PRIOR_STRENGTH), BIAS_STRENGTH) * max(times.sum(), 50)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(strength)
            step = np.linalg.solve(hess, x.T @ (times * (y - p)) - strength * (w - mean))
            w = w + np.clip(step, -2, 2)
        self.weights, self.bias = w[:-1], min(float(w[-1]), MOST_BIAS)


_WORD = re.compile(r"[^\W\d_]{4,}").findall


def _bag(text: str) -> set[str]:
    return set(_WORD(text.lower()))


INSULTS = {w for kind in (INSULT, AMBIGUOUS) for w in SEEDS[kind].split()}
SEED_FEATURES = {f"={w}" for w in INSULTS}


def _features(words: set[str]) -> set[str]:
    return {f"={w}" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


def is_mark(toxic: int, clean: int, n_toxic: int, n_clean: int) -> bool:
    """Whether a feature of so many toxic and clean documents is LIFT times as frequent among the toxic, and surely so."""
    if not toxic or toxic * n_clean < LIFT * (clean + 0.5) * n_toxic:
        return False
    total, every = toxic + clean, n_toxic + n_clean
    parts = ((toxic, total * n_toxic / every), (clean, total * n_clean / every))
    return 2 * sum(seen * math.log(seen / expected) for seen, expected in parts if seen) >= SURE


def learn_lexicon(texts: list[str], labels: list[int], least: int = 5) -> tuple[set[str], set[str]]:
    """(words, beginnings) that mark toxic texts (see is_mark), each explaining at least `least` more.

    A text that has two different insults of the seeds is explained by them. Equal texts count once. Of features that
    explain equally many, the most specific is taken: a word before a beginning, a longer beginning before a shorter one.
    """
    every = dict(zip(texts, labels, strict=True))
    bags = {kind: [_bag(t) for t, k in every.items() if k == kind] for kind in (0, 1)}
    held: dict[str, list[int]] = defaultdict(list)
    for i, bag in enumerate(bags[1]):
        for f in _features(bag):
            held[f].append(i)
    clean = Counter(f for bag in bags[0] for f in _features(bag) if f in held)
    n_toxic, n_clean = len(bags[1]), len(bags[0])
    holders = {f: ids for f, ids in held.items() if f in SEED_FEATURES or len(ids) >= least and is_mark(len(ids), clean[f], n_toxic, n_clean)}
    return _chosen(holders, {f for f in holders if not clean[f]}, n_toxic, least, lambda ids: {i: bags[1][i] for i in ids})


def learn_lexicon_of(rows: DataFrame, least: int = 5) -> tuple[set[str], set[str]]:
    """learn_lexicon of `rows` (text, label), an equal text with its larger label.

    Executors take whole texts apart and count their features. The driver gets the features that may be marks with their
    holders, at most TRAIN_PER_CLASS a feature, and the hashed words of those texts alone that are compared.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            bags = pa.array([sorted(_bag(t)) for t in texts_of(batch)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("label"), bags], names=["doc", "label", "words"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for label, bag in zip(*(batch.column(c).to_pylist() for c in ("label", "words")), strict=True):
                seen[label].update(_features(set(bag)))
            every = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(every), 100_000):
                part = every[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[k][f] for f in part], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])

    one = rows.groupBy(F.xxhash64("text").alias("doc")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    bags = materialise(one.mapInArrow(words, "doc bigint, label int, words array<string>"), "toxicity_bags")
    n = {r["label"]: r["count"] for r in bags.groupBy("label").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    counted = bags.mapInArrow(features, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, c, every = F.col("toxic"), F.col("clean"), n_toxic + n_clean
    ratio = 2 * (a * F.log(F.lit(float(every)) / max(n_toxic, 1) * a / (a + c)) + F.when(c > 0, c * F.log(F.lit(float(every)) / max(n_clean, 1) * c / (a + c))).otherwise(0.0))
    frequent = (a >= least) & (a * n_clean >= LIFT * (c + 0.5) * n_toxic) & (ratio >= SURE)
    kept = {r["feature"]: r["clean"] for r in counted.where(F.col("feature").isin(*sorted(SEED_FEATURES)) & (a > 0) | frequent).collect()}

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which toxic documents hold the features that may be marks."""
        for batch in sliced(batches, 100):
            pairs = [(f, doc) for doc, bag in zip(*(batch.column(c).to_pylist() for c in ("doc", "words")), strict=True) for f in _features(set(bag)) if f in kept]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.string()), pa.array([d for _, d in pairs], pa.int64())], names=["feature", "doc"])

    holders: dict[str, list[int]] = defaultdict(list)
    for f, doc in sorted(tuple(r) for r in bags.where("label = 1").mapInArrow(holding, "feature string, doc bigint").collect()):
        holders[f].append(doc)

    def hashed(ids: set[int]) -> dict[int, set[int]]:
        wanted = rows.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "doc bigint")
        return {r["doc"]: set(r["words"]) for r in bags.join(F.broadcast(wanted), "doc").select("doc", F.transform("words", lambda w: F.xxhash64(w)).alias("words")).collect()}

    lexicon = _chosen(dict(holders), {f for f, n in kept.items() if not n}, n_toxic, least, hashed)
    release(bags)
    return lexicon


def _chosen(holders: dict[str, list[int]], unmixed: set[str], n_toxic: int, least: int, bags_of: Callable[[set[int]], dict[int, set]]) -> tuple[set[str], set[str]]:
    """(words, beginnings) of the features in `holders`; those in `unmixed` no clean text has, and `bags_of` gives the words of toxic texts."""
    insults = Counter(i for f in SEED_FEATURES & holders.keys() for i in holders[f])
    known = {i for i, n in insults.items() if n > 1}
    left = {f: rest for f, ids in holders.items() if f not in SEED_FEATURES and len(rest := set(ids) - known) >= least}
    words, beginnings = set(), set()
    while left:
        best = max(left, key=lambda f: (len(left[f]), f[0] == "=", len(f), f))
        covered = set(left[best])
        (words if best[0] == "=" else beginnings).add(best.lstrip("="))
        left = {f: rest for f, ids in left.items() if len(rest := ids - covered) >= least}
    # Marks that only ever come with others explain nothing more here, but may stand alone elsewhere: those that no
    # clean text has and many unlike toxic texts have (near copies of one text would share all their words).
    many = max(4 * least, n_toxic // 100)

    def explained(core: str) -> bool:
        return any(core[:n] in beginnings for n in PREFIXES) or any(x.startswith(core) for x in (*words, *INSULTS, *beginnings))

    further = [f for f in unmixed if len(holders[f]) >= many and not explained(f.lstrip("="))]
    bags = bags_of({i for f in further for i in holders[f]}) if further else {}
    for f in sorted(further, key=lambda f: (-len(holders[f]), f[0] != "=", -len(f), f)):
        core = f.lstrip("=")
        if explained(core):
            continue
        ids = holders[f]
        alike = [len(bags[a] & bags[b]) / len(bags[a] | bags[b]) for a, b in zip(ids, ids[1:], strict=False)]
        if sum(alike) < 0.3 * len(alike):
            (words if f[0] == "=" else beginnings).add(core)
    return words, beginnings


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> ToxicityModel:
    """Lexicon and weights from whole texts of at most `per_class` labelled rows of each class outside the held-out fold.

    The texts stay in the shared folder and with the executors; the driver gets features and counts of patterns. An empty
    table, and one without labels, leave the seed lexicon and the prior weights.

    Each row weighs as many labelled rows of its class outside the fold as it stands for, so that a score doesn't depend
    on which class the sample cuts; a mere shift of the bias would leave out that the prior draws it as well.
    """
    rows = materialise(training_rows(docs, labels, "toxic", FOLDS, HELD, per_class), "toxicity_sample")
    model = ToxicityModel(*learn_lexicon_of(rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            yield pa.RecordBatch.from_arrays([pa.array([model.counts(t).tolist() for t in texts_of(batch)], pa.list_(pa.float64())), batch.column("label")], names=["counts", "label"])

    counted = rows.mapInArrow(count, "counts array<double>, label int").collect()
    if counted:
        y = np.array([r["label"] for r in counted])
        weights = np.array(sampling_weights(labels, "toxic", FOLDS, HELD, per_class))
        model.fit(np.array([r["counts"] for r in counted]), y.astype(float), weights[y])
    release(rows)
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """`docs` with the score of its text in a further column; every other column passes through.

    Null and empty texts, however long ones, repeats and empty tables are as in score_toxicity. ValueError if `docs` has
    a column of that name.
    """
    if column in docs.columns:
        raise ValueError(f"there is a column {column!r} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{column}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = np.array([model.counts(t) for t in texts_of(batch)]).reshape(-1, len(PATTERNS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(counts))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text); other columns are ignored.

    Scores depend on the text alone, whole however long. Null and empty texts get the score of a text without matches; repeated rows stay;
    an empty table gives no rows; a null doc_id stays null and is held out (its text is empty: crc32 0).
    """
    scored = with_toxicity(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` that score below THRESHOLD, with the columns of `docs`, whatever their names.

    Scored and dropped in the task that reads them, whole texts of any length. Null and empty texts stay, repeated rows
    stay or go together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = np.array([model.counts(t) for t in texts_of(batch)]).reshape(-1, len(PATTERNS))
            yield batch.filter(pa.array(model.score(counts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
