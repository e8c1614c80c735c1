"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on a whole text. Their votes are counted
per combination over all documents (at most 3 ** labellers rows reach the driver), and expectation
maximisation estimates each labeller's accuracy on good and on bad documents and the share of good
ones, without any true label. The posterior of a combination is the label of its documents. On a
bounded sample of documents (SAMPLE) a logistic regression over hashed features of word shapes is
trained with these posteriors as soft labels; it scores every document. (The sample is at most
SAMPLE x WIDTH numbers, so the driver fits it by accelerated gradient steps; Spark ML's logistic
regression had not converged on these sparse shares after 60 passes.)

The sample holds as many documents that the posterior calls bad as good ones (all of a kind that is
rare), each weighted by how many it stands for, so both kinds are seen wherever the labellers find them.
It is drawn by a hash of identifier and text, so it is the same at every run. Each pass over the
documents is one scan without a shuffle of texts; the first one leaves 12 bytes a document in the shared
folder, from which the sample is chosen.

null or empty text: no labeller votes, the features are empty, and the document is kept, since
nothing speaks against it. null ids stay null, repeated rows get equal scores, ties (a score of
exactly one half) are kept. If the posterior finds no bad or no good document, all are kept with score 1.
Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.bpe import text_slices
from basinflow.llm.common import cut, small_batches

#: Documents on which the scorer is trained; hashed features.
SAMPLE, WIDTH = 4000, 1024
#: Characters of the longest words and shapes that the caches keep; longer ones are worked out each time.
KEPT = 32
LABELLERS = ("sign_ends", "shouting", "exclaiming", "bare_signs", "stuttering", "few_words", "repeated_lines", "sign_share", "letter_share", "plain_words")
LETTERS, OTHERS = re.compile(r"[^\W\d_]+"), re.compile(r"[^\w\s]+|_+")


def shape(word: str) -> str:
    """Shape of a whole word: runs of small letters, capitals, digits and other signs."""
    out, last = [], ""
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "b" if c.isalpha() else c
        if k != last:
            out.append(k)
            last = k
    return "".join(out)


class Shapes(dict):
    """Shapes of words. Those of long words are not kept, nor more than so many."""

    def __missing__(self, word: str) -> str:
        out = shape(word)
        if len(word) <= KEPT:
            if len(self) >= 200_000:
                self.clear()
            self[word] = out
        return out


SHAPES = Shapes()
#: Shapes of plain words; of words that end in a sign that prose does not end words with.
PLAIN = re.compile(r"[(\"']?(?:A?a|A|0|b)(?:['-](?:A?a|A|0|b))*['\")]?[.,;:?!]?")
SIGN_END, BARE = re.compile(r".*[aAb0][^aAb0.,;:?!'\")]$"), re.compile(r"[^aAb0]+")


def shapes_of(text: str) -> Counter:
    """Counts of the word shapes; a word that repeats the one before also counts as `same`."""
    words = text.split()
    out = Counter(map(SHAPES.__getitem__, words))
    if same := sum(map(str.__eq__, words, words[1:])):
        out["same"] = same
    return out


def kind_of(s: str) -> tuple[bool, bool, bool, bool, bool]:
    return short_kind(s) if len(s) <= KEPT else kind(s)


def kind(s: str) -> tuple[bool, bool, bool, bool, bool]:
    """Of a shape: ends in a sign, capitals only, ends in `!`, signs only, plain."""
    return bool(SIGN_END.fullmatch(s)), "A" in s and "a" not in s and s != "A", s.endswith("!"), bool(BARE.fullmatch(s)), bool(PLAIN.fullmatch(s))


short_kind = lru_cache(maxsize=50_000)(kind)


def measures(text: str) -> tuple[dict, Counter]:
    """What the labellers look at, over the whole text, and the counts of its word shapes."""
    shapes = shapes_of(text)
    n = sum(k for s, k in shapes.items() if s != "same")
    many = max(1, n)
    share = [sum(k for s, k in shapes.items() if s != "same" and kind_of(s)[i]) / many for i in range(5)]
    solid = max(1, len(text) - sum(map(text.count, " \n\t\r")))
    letters, signs = (sum(map(len, f.findall(text))) for f in (LETTERS, OTHERS))
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    return {
        "n": n, "lines": len(lines), "sign_ends": share[0], "shouting": share[1], "exclaiming": share[2], "bare_signs": share[3], "stuttering": shapes["same"] / many, "few_words": len(set(text.split())) / many,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "sign_share": signs / solid, "letter_share": letters / solid, "plain_words": share[4],
    }, shapes


def vote(value: float, good: float | None, bad: float) -> int:
    """1 on the side of good, -1 on the side of bad, 0 between; good None: -1 or 0."""
    if good is None:
        return -1 if value >= bad else 0
    return 1 if value >= good else -1 if value <= bad else 0


def votes(m: dict) -> list[int]:
    """The labellers' votes, in the order of LABELLERS. A share of few words says little, so shares are
    taken as if some more words spoke for the text: bad words against three more good ones, plain words
    with one and a half more plain ones. Only one labeller can speak for a text: several that all see
    plain words would count them twice."""
    doubt = m["n"] / (m["n"] + 3)
    plain = (m["plain_words"] * m["n"] + 1.5) / (m["n"] + 1.5)
    share = lambda name, bad: vote(doubt * m[name], None, bad)
    return [
        share("sign_ends", 0.3), share("shouting", 0.4), share("exclaiming", 0.4), share("bare_signs", 0.25), share("stuttering", 0.3),
        -1 if m["n"] >= 30 and m["few_words"] <= 0.15 else 0, vote(m["repeated_lines"], None, 0.6) if m["lines"] >= 5 else 0, share("sign_share", 0.2), vote(doubt * (1 - m["letter_share"]), None, 0.3), 1 if m["n"] and m["plain_words"] >= 0.85 else -1 if plain <= 0.6 else 0,
    ]


def hashed(shapes: Counter) -> np.ndarray:
    """Shares of the word shapes under a hash, scaled to length one."""
    import xxhash

    out = np.zeros(WIDTH)
    for s, k in shapes.items():
        out[xxhash.xxh64_intdigest(s, 7) % WIDTH] += k
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def voted(rows: DataFrame) -> DataFrame:
    """mark (a hash) and code (all votes as one number) of rows(mark, text)."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                code = [sum((v + 1) * 3**i for i, v in enumerate(votes(measures(t or "")[0]))) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(code, pa.int32())], names=["mark", "code"])

    return rows.select("mark", "text").mapInArrow(run, "mark long, code int")


def featured(rows: DataFrame) -> DataFrame:
    """mark, code and the hashed features (places and shares) of rows(mark, code, text)."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(2)):
                dense = [hashed(shapes_of(t or "")) for t in texts]
                own = [batch.column(i).slice(at, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([np.flatnonzero(x) for x in dense], pa.list_(pa.int32())), pa.array([x[x != 0] for x in dense], pa.list_(pa.float64()))], names=["mark", "code", "places", "shares"])

    return rows.select("mark", "code", "text").mapInArrow(run, "mark long, code int, places array<int>, shares array<double>")


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of `good` per vote combination, share of good documents, and accuracies of the
    labellers (on bad and on good documents, of those they vote on). Each labeller has a share of
    bad, no and good votes on either kind; starts from bad wherever one labeller says so."""
    cast = np.array([[(c // 3**i) % 3 for i in range(len(LABELLERS))] for c in codes])
    q = np.where((cast == 0).any(1), 0.1, 0.9)
    for _ in range(rounds):
        share = (q @ counts + 1) / (counts.sum() + 2)
        table = np.empty((2, len(LABELLERS), 3))
        for kind, weight in ((0, (1 - q) * counts), (1, q * counts)):
            for i in range(len(LABELLERS)):
                hits = np.bincount(cast[:, i], weight, 3) + np.array([[1.0, 1.0, 0.01], [0.01, 1.0, 1.0]][kind])
                table[kind, i] = hits / hits.sum()
        log = np.log(share / (1 - share)) + sum(np.log(table[1, i, cast[:, i]] / table[0, i, cast[:, i]]) for i in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-9:
            break
    right = np.stack([table[0, :, 0] / (table[0, :, 0] + table[0, :, 2]), table[1, :, 2] / (table[1, :, 0] + table[1, :, 2])], axis=1)
    return q, float(share), right


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Accuracies of the labellers and the weights of the scorer (None if there is one kind only)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = rows_of(docs, id_col, text_col).withColumn("mark", F.xxhash64(F.lit(11), "doc_id", "text"))
    cast = cut(voted(rows))
    counted = sorted(cast.groupBy("code").agg(F.count("*").alias("n")).collect())
    silent = sum(3**i for i in range(len(LABELLERS)))
    codes, counts = np.array([r["code"] for r in counted if r["code"] != silent], int), np.array([r["n"] for r in counted if r["code"] != silent], float)
    if not len(codes):
        return {"weights": None}
    posterior, share, accuracy = expectation_maximisation(codes, counts)
    out = {"weights": None, "share": share, "accuracy": dict(zip(LABELLERS, accuracy.tolist())), "posterior": dict(zip(codes.tolist(), posterior.tolist()))}
    good = posterior >= 0.5
    if good.all() or not good.any():
        return out
    # At most `sample` marks reach the driver; equal ones (repeated rows) count as one.
    picked = []
    for kind in (good, ~good):
        total = counts[kind].sum()
        drawn = cast.where(F.col("code").isin(codes[kind].tolist())).where(F.pmod("mark", F.lit(1 << 40)) <= int(min(1.0, 2 * sample / total) * (1 << 40)))
        picked += [(r["mark"], r["code"]) for r in drawn.select("mark", "code").distinct().orderBy("mark").limit(sample // 2).collect()]
    chosen = F.broadcast(spark.createDataFrame(picked, "mark long, code int"))
    trained = featured(rows.select("mark", "text").join(chosen, "mark")).dropDuplicates(["mark"]).orderBy("mark").collect()
    x, p = np.zeros((len(trained), WIDTH)), np.array([out["posterior"][r["code"]] for r in trained])
    for i, r in enumerate(trained):
        x[i, r["places"]] = r["shares"]
    sure = p >= 0.5
    weight = np.where(sure, counts[good].sum() / max(1, sure.sum()), counts[~good].sum() / max(1, (~sure).sum()))
    out["weights"], out["intercept"] = logistic(x, p, weight / weight.mean())
    return out


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic regression on soft labels p of weighted rows."""
    used = np.flatnonzero(x.any(0))
    design = np.hstack([x[:, used], np.ones((len(x), 1))])
    w = look = np.zeros(design.shape[1])
    step = 1 / (0.25 * np.linalg.eigvalsh((design * weight[:, None]).T @ design / len(design))[-1] + penalty)
    for k in range(rounds):
        slope = design.T @ (weight * (1 / (1 + np.exp(-design @ look)) - p)) / len(design) + penalty * np.append(look[:-1], 0)
        new = look - step * slope
        look, w = new + k / (k + 3) * (new - w), new
    out = np.zeros(x.shape[1])
    out[used] = w[:-1]
    return out, float(w[-1])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (of being good) and kept of every row."""
    small_batches(docs.sparkSession)
    weights, intercept = model["weights"], model.get("intercept", 0.0)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                out = scores(texts, weights, intercept)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(out), pa.array(out >= 0.5)], names=["doc_id", "score", "kept"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, kept boolean")


def scores(texts: list[str | None], weights: np.ndarray | None, intercept: float) -> np.ndarray:
    out = np.ones(len(texts))
    if weights is not None:
        for i, t in enumerate(texts):
            shapes = shapes_of(t or "")
            if shapes:
                out[i] = round(1 / (1 + np.exp(-np.clip(hashed(shapes) @ weights + intercept, -30, 30))), 6)
    return out


def filter_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the scorer keeps."""
    small_batches(docs.sparkSession)
    weights, intercept = model["weights"], model.get("intercept", 0.0)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(scores([None if t is None else t for t in texts], weights, intercept) >= 0.5)

    return docs.where(kept(F.col(text_col).cast("string")))
