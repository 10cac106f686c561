"""Operator 4, toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character trigram model is counted over every text (each task sums its own counts; tables of a fixed size
   meet in one aggregation).
2. Words that may hide another word (digits or marks among letters, letters repeated three times or more, single
   letters set apart) become character lattices: each mark stands for itself, for letters that look like it, or for
   nothing, each repeated letter may go. Viterbi decoding finds the likeliest letters under the trigram model.
   A word of plain letters has one path, itself. Words of any length are decoded, whole and cut into words by the
   model; letters set apart are also cut at their wider gaps.
3. Restored words and their first letters are the features. Those that tell the classes apart are found in a
   bounded sample of labelled rows, and a logistic regression weighs them.

Three passes over the texts, no shuffle of texts. What is broadcast: the trigram table (64³ numbers), the drawn
labels (a parameter bounds them) and the weights of features, of which the sample's texts have only so many.

Cases: null text counts as empty and gets the score of a text without features; rows without a label or with a
null one don't train; with no labels the score is 0 everywhere; copies of a text with one label train once;
repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import bounded_sample
from .shared import map_column, map_parts, materialize, text_rows, tidy, with_column
from .token_counts import slices

THRESHOLD = 0.3  # of the score, for the verdict
CACHE = 60_000  # tokens whose features a worker keeps
HELD = 60_000  # counts that a task holds before it hands them on

#: Letters that a mark or digit may stand for (fixed values: the common substitutions).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
MARKS = re.escape("".join(LOOKS) + ".-_*'~^`,:;#%&=/\\")
LETTER = r"[^\W\d_]"
PLAIN = re.compile(f"{LETTER}+")
HIDING = re.compile(f"{LETTER}[{MARKS}]+{LETTER}|[{re.escape(''.join(c for c in LOOKS if c not in '!|+('))}]{LETTER}|{LETTER}[{re.escape(''.join(c for c in LOOKS if c.isdigit() or c in '@$'))}]|({LETTER})\\1\\1")
SIGN = rf"(?:[^\W_]|[{re.escape(''.join(c for c in LOOKS if not c.isdigit()))}])"
APART = re.compile(rf"(?<!\S)(?:{SIGN}[ .\-_*]{{1,2}}){{2,}}{SIGN}(?![^\s.,!?])")
GAP, WIDE = re.compile(r"[ .\-_*]+"), re.compile(r"[ .\-_*]{2}")
EDGES = re.compile(r"^(?:([^\w\s])\1\1+|([^\w\s$@])\2)|(?:([^\w\s])\3\3+|([^\w\s$@])\4)$")


@dataclass(frozen=True)
class ToxicitySetup:
    """Bounds and constants of training and decoding."""

    max_rows: int = 20_000  # labelled rows that training reads
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    least_evidence: float = 12.0  # likelihood ratio that a feature needs
    rounds: int = 1000
    penalty: float = 0.1


def _alphabet() -> np.ndarray:
    """Code point -> symbol of the trigram model: 0 no letter, 1-26 a-z, 27-58 Latin letters with marks, 59 other letters."""
    out = np.zeros(0x3000, dtype=np.uint8)
    for cp in range(len(out)):
        low = chr(cp).lower()[:1]
        if chr(cp).isalpha():
            o = ord(low)
            out[cp] = o - 96 if 97 <= o <= 122 else o - 0xDF + 27 if 0xDF <= o <= 0xFE else 59
    return out


ALPHABET = _alphabet()
SIZE = 64
STATES = 24  # that are decoded one by one
COMMIT = 512  # characters after which what all paths have in common is settled


def symbol(letter: str) -> int:
    return int(ALPHABET[min(ord(letter), len(ALPHABET) - 1)])


def symbols(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return ALPHABET[np.minimum(cps, len(ALPHABET) - 1)]


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities (64³, float32) of a letter after two others, counted over every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            for a, b in slices(texts):
                s = symbols("\n".join(texts[a:b])).astype(np.int64)
                s = np.r_[0, s, 0, 0]
                total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = map_parts(docs.select(F.col(text).cast("string").alias("text")), "text", run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3)
    for r in rows.toLocalIterator():
        counts[r["gram"]] = r["n"]
    three = counts.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    base = (one + 1) / (one.sum() + SIZE)
    after_one = (two + 20 * base[None, :]) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 5 * after_one[None]) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32).ravel()


def _said(chain: tuple | None) -> str:
    """The letters of a chain of (before, letter)."""
    out = []
    while chain:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


class Restorer:
    """Viterbi decoding of one token's character lattice: the best path of all."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams

    def choices(self, token: str) -> list[list[tuple[str, float]]]:
        """For each character, the letters that it may stand for ("" for none) with their log likelihoods."""
        out: list[list[tuple[str, float]]] = []
        made: dict[tuple[str, bool], list[tuple[str, float]]] = {}  # a long token's places share their lists
        before = ""
        for c in token:
            if (found := made.get((c, c == before))) is None:
                if c in LOOKS:
                    found = [(x, -1.0) for x in LOOKS[c]] + [("", -4.0)]
                elif c.isalpha():
                    found = [(c, -0.05), ("", -0.7)] if c == before else [(c, -0.05)]
                else:
                    found = [("", -0.3)]
                made[c, c == before] = found
            out.append(found)
            before = c
        return out

    def restore(self, token: str, breaks: bool = False) -> str:
        """The likeliest letters; token is in lower case. breaks: with spaces where the model sees words end."""
        return self.decode(token, breaks)[1]

    def decode(self, token: str, breaks: bool, states: int = STATES) -> tuple[float, str]:
        """Log likelihood and letters of the best path. The state is the last two symbols; more than `states` of them at a
        time are held as arrays, and there is no limit to them."""
        grams = self.grams
        lattice = self.choices(token)
        # what is said so far is a chain of (before, letter), so that a step costs the same in a long token
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        settled: list[str] = []
        for at, choices in enumerate(lattice):
            if at % COMMIT == COMMIT - 1 and len(best) == 1:  # all paths have what is said so far in common
                ((state, (p, said)),) = best.items()
                settled.append(_said(said))
                best = {state: (p, None)}
            if breaks:
                for (a, b), (p, said) in list(best.items()):
                    if b and ((b, 0) not in best or p + float(grams[(a * SIZE + b) * SIZE]) > best[b, 0][0]):
                        best[b, 0] = (p + float(grams[(a * SIZE + b) * SIZE]), (said, " "))
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, said) in best.items():
                for letter, cost in choices:
                    if letter:
                        c = symbol(letter)
                        key, q = (b, c), p + cost + float(grams[(a * SIZE + b) * SIZE + c])
                    else:
                        key, q = (a, b), p + cost
                    if key not in nxt or q > nxt[key][0]:
                        nxt[key] = (q, (said, letter) if letter else said)
            if len(nxt) > states:
                return self._decode_by_arrays(lattice, breaks)
            best = nxt
        score, said = max(((p + (float(grams[(a * SIZE + b) * SIZE]) if b or not breaks else 0.0), said) for (a, b), (p, said) in best.items()), key=lambda x: x[0], default=(0.0, None))
        return score, "".join([*settled, _said(said)])

    def _decode_by_arrays(self, lattice: list[list[tuple[str, float]]], breaks: bool) -> tuple[float, str]:
        """The same with the scores of all states as a square array over the symbols that the token can have."""
        codes = sorted({0} | {symbol(x) for choices in lattice for x, _ in choices if x})
        place = {c: k for k, c in enumerate(codes)}
        k = len(codes)
        by_last = np.ascontiguousarray(self.grams.reshape(SIZE, SIZE, SIZE)[np.ix_(codes, codes, codes)].astype(np.float64).transpose(2, 0, 1))
        now = np.full((k, k), -np.inf)
        now[0, 0] = 0.0
        steps: list[tuple] = []  # for each character: its choices, where a break came from, by the symbol before it; and each state's choice and the symbol that it lost
        settled: list[str] = []
        every = np.arange(k)
        for choices in lattice:
            broke = None
            if breaks:
                ends = now + by_last[0]
                before = ends.argmax(axis=0)
                reached = ends[before, every]
                better = reached > now[:, 0]
                better[0] = False
                broke = np.where(better, before, -1).astype(np.int16)
                now = now.copy()
                now[better, 0] = reached[better]
            nxt, chosen, lost = np.full((k, k), -np.inf), np.full((k, k), -1, dtype=np.int8), np.zeros((k, k), dtype=np.int16)
            for i, (letter, cost) in enumerate(choices):
                if not letter:
                    better = now + cost > nxt
                    nxt[better], chosen[better] = now[better] + cost, i
                    continue
                c = place[symbol(letter)]
                reach = now + by_last[c]
                before = reach.argmax(axis=0)
                q = reach[before, every] + cost
                better = q > nxt[:, c]
                nxt[better, c], chosen[better, c], lost[better, c] = q[better], i, before[better]
            steps.append((choices, broke, chosen, lost))
            now = nxt
            if len(steps) % COMMIT == 0:
                text, steps = self._settle(steps, now)
                settled.append(text)
        total = now + by_last[0]
        if breaks:
            total[:, 0] = now[:, 0]
        a, b = divmod(int(total.argmax()), k)
        return float(total[a, b]), "".join([*settled, self._back(steps, a, b)])

    @staticmethod
    def _back(steps: list[tuple], a: int, b: int) -> str:
        """The letters of the best path to a state."""
        out = []
        for choices, broke, chosen, lost in reversed(steps):
            letter = choices[chosen[a, b]][0]
            if letter:
                out.append(letter)
                a, b = int(lost[a, b]), a
            if broke is not None and b == 0 and broke[a] >= 0:
                out.append(" ")
                a, b = int(broke[a]), a
        return "".join(reversed(out))

    def _settle(self, steps: list[tuple], now: np.ndarray) -> tuple[str, list[tuple]]:
        """The letters that the best paths to all states have in common, and the steps after them: paths are traced back together
        until they have met in one state. What is held is thus a few steps, however long a token is."""
        a, b = np.nonzero(now > -np.inf)
        for t in range(len(steps) - 1, 0, -1):
            choices, broke, chosen, lost = steps[t]
            said = np.array([bool(letter) for letter, _ in choices])[chosen[a, b]]
            a, b = np.where(said, lost[a, b], a), np.where(said, a, b)
            if broke is not None:
                came = (b == 0) & (broke[a] >= 0)
                a, b = np.where(came, broke[a], a), np.where(came, a, b)
            if (a == a[0]).all() and (b == b[0]).all():
                return self._back(steps[:t], int(a[0]), int(b[0])), steps[t:]
        return "", steps

    def hidden(self, spelled: str) -> list[str]:
        """What a spelled word says: all its letters together, and the words that the model cuts them into."""
        squeezed = re.sub(r"(.)\1{2,}", r"\1\1", spelled)
        return list(dict.fromkeys(w for w in (self.restore(squeezed), *self.restore(squeezed, breaks=True).split()) if w))

    def words(self, token: str) -> list[str]:
        """The words that a token (lower case, no white space) may be: its plain ones, and the restored ones if it may hide some."""
        plain = PLAIN.findall(token)
        core = EDGES.sub("", EDGES.sub("", token))
        if HIDING.search(core):
            plain += [w for w in self.hidden(core) if w not in plain]
        return plain

    def apart(self, text: str) -> list[str]:
        """Words spelled as single letters set apart, put together and restored; also between the wider gaps of a run."""
        found: dict[str, None] = {}
        for m in APART.finditer(text):
            for spelled in dict.fromkeys((m.group(), *WIDE.split(m.group()))):
                if len(letters := GAP.sub("", spelled)) > 1:
                    found |= dict.fromkeys(self.hidden(letters))
        return list(found)


class Features:
    """Features of texts; keeps the features of tokens it has met."""

    def __init__(self, grams: np.ndarray, setup: ToxicitySetup, chosen: dict[str, int] | None = None):
        self.restorer, self.setup, self.chosen = Restorer(grams), setup, chosen
        self.known: dict[str, tuple] = {}

    def _of_word(self, word: str) -> list[str]:
        return [word] + [f"^{word[:n]}" for n in self.setup.prefixes if len(word) >= n]

    def _of_words(self, words: list[str]) -> tuple:
        found = {f for w in words for f in self._of_word(w)}
        return tuple(found) if self.chosen is None else tuple(self.chosen[f] for f in found if f in self.chosen)

    def of_text(self, text: str) -> set:
        low = text.lower()
        known, out = self.known, set()
        tokens = set(low.split())
        for t in tokens:
            f = known.get(t)
            if f is None:
                f = known[t] = self._of_words(self.restorer.words(t) if not t.isalpha() or HIDING.search(t) else [t])
            if f:
                out.update(f)
        if words := self.restorer.apart(low):
            out.update(self._of_words(words))
        if len(known) > CACHE:
            known.clear()
        return out


class ToxicityModel:
    def __init__(self, grams: np.ndarray, setup: ToxicitySetup, chosen: dict[str, int], weights: np.ndarray, bias: float):
        self.grams, self.setup, self.chosen, self.weights, self.bias = grams, setup, chosen, weights, bias

    def scorer(self):
        features = Features(self.grams, self.setup, self.chosen)

        def score(text: str | None) -> float:
            z = self.bias + sum(self.weights[i] for i in features.of_text(text or ""))
            return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))

        return score


def _fit(lengths: np.ndarray, cols: np.ndarray, y: np.ndarray, size: int, setup: ToxicitySetup) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features with a squared penalty: accelerated gradient steps, each scaled by a bound of its curvature."""
    n = len(lengths)
    at = np.repeat(np.arange(n), lengths)
    curvature = np.r_[0.25 * np.bincount(cols, weights=lengths[at] + 1.0, minlength=size) + setup.penalty, 0.25 * (lengths + 1.0).sum()]
    w = np.zeros(size + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    ahead, t = w.copy(), 1.0
    for _ in range(setup.rounds):
        z = ahead[-1] + np.bincount(at, weights=ahead[cols], minlength=n)
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.r_[np.bincount(cols, weights=gap[at], minlength=size) + setup.penalty * ahead[:-1], gap.sum()]
        new = ahead - slope / curvature
        if (slope * (new - w)).sum() > 0:
            t = 1.0
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, setup: ToxicitySetup = ToxicitySetup(), doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """docs: all texts (for the trigram model); labels: (doc_id, label 0 or 1), of which a bounded sample trains."""
    spark = docs.sparkSession
    grams = count_trigrams(docs, text)
    drawn = bounded_sample(labels.filter(F.col("label").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label")), "doc_id", setup.max_rows)
    # at most max_rows rows of two numbers: small enough for every executor
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = materialize(joined.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text")), "toxicity-rows")
    shared = spark.sparkContext.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, by = Features(shared.value, setup), (Counter(), Counter())

        def told() -> pa.RecordBatch:
            names = list(by[0].keys() | by[1].keys())
            out = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in by)]
            by[0].clear(), by[1].clear()
            return pa.RecordBatch.from_arrays(out, names=["feature", "n0", "n1"])

        for batch in batches:
            for label, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by[int(label == 1)].update(features.of_text(t))
            if len(by[0]) + len(by[1]) > HELD:  # counts are handed on in parts, and summed up by Spark
                yield told()
        yield told()

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), sum(v for k, v in totals.items() if k != 1)
    if not n1 or not n0:
        return ToxicityModel(grams, setup, {}, np.zeros(0), -50.0 if not n1 else 50.0)
    counted = map_parts(rows, "text", count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n, base = F.col("n0") + F.col("n1"), n1 / (n0 + n1)
    share = F.col("n1") / n
    term = lambda c, p, q: F.when(c > 0, c * F.log(p / q)).otherwise(0.0)
    ratio = 2 * (term(F.col("n1"), share, F.lit(base)) + term(F.col("n0"), 1 - share, F.lit(1 - base)))
    best = counted.filter(share > base).withColumn("ratio", ratio).filter(F.col("ratio") >= setup.least_evidence).orderBy(F.desc("ratio"), "feature").select("feature").toArrow()  # of the bounded sample
    chosen = {f: k for k, f in enumerate(best["feature"].to_pylist())}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value, setup, chosen)
        for batch in batches:
            has = [sorted(features.of_text(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(has, pa.list_(pa.int32()))], names=["label", "has"])

    picked = map_parts(rows, "text", pick, "label int, has array<int>").toArrow()  # the bounded sample, a few ids a row
    has = pa.concat_arrays(picked["has"].chunks) if picked.num_rows else pa.array([], pa.list_(pa.int32()))
    y = (picked["label"].to_numpy() == 1).astype(np.float64)
    w, b = _fit(np.diff(has.offsets.to_numpy()), has.values.to_numpy()[has.offsets[0].as_py() :].astype(np.int64), y, len(chosen), setup)
    del picked, has
    tidy()
    return ToxicityModel(grams, setup, chosen, w, b)


def score_documents(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, score, predicted and the carried columns for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        one = shared.value.scorer()
        return lambda values: {"score": pa.array([one(t) for t in values], pa.float64())}

    scored = map_column(text_rows(docs, doc_id, text, carry), "text", start, "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def add_scores(rows: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """rows with a score column of the given name; only the text goes to Python, and only the score comes back."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def start():
        one = shared.value.scorer()
        return lambda values: pa.array([one(t) for t in values], pa.float64())

    return with_column(rows.withColumn(text, F.col(f"`{text}`").cast("string")), text, start, score, "double")
