"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a run of letters byte by byte in both directions and gives every byte a distribution over the
languages. A document's distribution is the mean over all bytes of all its runs. It is trained in numpy by
backpropagation through time on a bounded sample; a task runs each distinct run of letters once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.llm.common import map_batches

#: Bounds of the training sample: documents per language, and distinct runs of letters per language.
SAMPLE_DOCS = 400
SAMPLE_RUNS = 6000
#: Letters of a run; longer ones are cut into runs of this many.
RUN_LETTERS = 24
#: Letters alone; Python's own word characters hold numbers such as fractions, too.
RUNS = regex.compile(f"\\p{{L}}{{1,{RUN_LETTERS}}}").findall
UNDETERMINED = "und"

HIDDEN, EMBEDDING = 16, 8
#: Ids that are broadcast at most.
BROADCAST_IDS = 1 << 20
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.01, 17
#: Distinct runs in a task's table before it is emptied, and bytes of text looked up at a time.
TABLE_RUNS = 400_000
BLOCK = 2 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"embedding": rng.normal(0, 0.3, (256, EMBEDDING))}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 1 / np.sqrt(EMBEDDING), (EMBEDDING, 3 * HIDDEN))
        w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
        w[f"c{side}"] = np.zeros(3 * HIDDEN)
    w["out"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), (2 * HIDDEN, classes))
    w["bias"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _gru(w: dict[str, np.ndarray], side: str, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte, for codes of shape (time, batch); the backward side reads from the end."""
    inputs = w["embedding"] @ w[f"x{side}"] + w[f"c{side}"]
    times = range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1)
    state = np.zeros((codes.shape[1], HIDDEN), np.float32)
    out = np.empty((*codes.shape, HIDDEN), np.float32)
    u, v = w[f"h{side}"][:, : 2 * HIDDEN], w[f"h{side}"][:, 2 * HIDDEN :]
    for t in times:
        x = inputs[codes[t]]
        gates = _sigmoid(x[:, : 2 * HIDDEN] + state @ u)
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        fresh = 2 * _sigmoid(2 * (x[:, 2 * HIDDEN :] + (reset * state) @ v)) - 1
        if keep is not None:
            keep.append((t, state, update, reset, fresh))
        state = state + update * (fresh - state)
        out[t] = state
    return out


def label_positions(w: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """A distribution over the languages for every byte: (time, batch, classes)."""
    states = np.concatenate([_gru(w, "f", codes), _gru(w, "b", codes)], axis=2)
    scores = states @ w["out"] + w["bias"]
    scores = np.exp(scores - scores.max(axis=2, keepdims=True))
    return scores / scores.sum(axis=2, keepdims=True)


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted cross-entropy over all positions, and its gradient by backpropagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_gru(w, s, codes, kept[s]) for s in "fb"], axis=2)
    scores = states @ w["out"] + w["bias"]
    scores -= scores.max(axis=2, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=2, keepdims=True)
    who = np.arange(codes.shape[1])
    loss = float(-(np.log(p[:, who, label] + 1e-12) * weight).sum())
    p[:, who, label] -= 1
    p *= weight[None, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = np.einsum("tbh,tbc->hc", states, p)
    g["bias"] = p.sum(axis=(0, 1))
    back = p @ w["out"].T
    for side, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
        u, v = w[f"h{side}"][:, : 2 * HIDDEN], w[f"h{side}"][:, 2 * HIDDEN :]
        carried = np.zeros((codes.shape[1], HIDDEN), np.float32)
        table = np.zeros((256, 3 * HIDDEN), np.float32)
        for t, state, update, reset, fresh in reversed(kept[side]):
            d = part[t] + carried
            d_fresh = d * update * (1 - fresh**2)
            d_gated = d_fresh @ v.T
            d_gates = np.concatenate(
                [d * (fresh - state) * update * (1 - update), d_gated * state * reset * (1 - reset)], axis=1
            )
            carried = d * (1 - update) + d_gated * reset + d_gates @ u.T
            g[f"h{side}"][:, : 2 * HIDDEN] += state.T @ d_gates
            g[f"h{side}"][:, 2 * HIDDEN :] += (reset * state).T @ d_fresh
            np.add.at(table, codes[t], np.concatenate([d_gates, d_fresh], axis=1))
        g[f"c{side}"] = table.sum(axis=0)
        g[f"x{side}"] = w["embedding"].T @ table
        g["embedding"] += table @ w[f"x{side}"].T
    return loss, g


def _by_length(runs: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of equal length together: their places and their codes as (time, batch)."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, edges) if len(order) else []:
        data = np.frombuffer(b"".join([runs[i] for i in places]), np.uint8)
        yield places, data.reshape(len(places), -1).T


def train(rows: Sequence[tuple[str, bytes, float]], languages: Sequence[str]) -> dict[str, np.ndarray]:
    """Weights fitted to ``(language, run, count)``; every language counts the same in all."""
    rng = np.random.default_rng(SEED)
    w = new_weights(len(languages), rng)
    index = {name: i for i, name in enumerate(languages)}
    label = np.array([index[r[0]] for r in rows])
    runs = [r[1] for r in rows]
    weight = np.array([r[2] * len(r[1]) for r in rows], np.float64)
    weight /= np.bincount(label, weight, len(languages))[label]
    weight = (weight / np.fromiter(map(len, runs), np.float64, len(runs)) * len(rows)).astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        batches = []
        for places, codes in _by_length(runs):
            mixed = rng.permutation(len(places))
            batches += [(places[m], codes[:, m]) for m in np.array_split(mixed, -(-len(mixed) // BATCH))]
        for b in rng.permutation(len(batches)):
            places, codes = batches[b]
            _, g = gradients(w, codes, label[places], weight[places] / len(places))
            step += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k in w:
                d = g[k] * min(1.0, 5 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * d
                square[k] = 0.99 * square[k] + 0.01 * d * d
                ahead = mean[k] / (1 - 0.9**step)
                spread = np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6
                w[k] -= (RATE * (1 - epoch / EPOCHS) * ahead / spread).astype(np.float32)
    return w


def training_runs(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, learns: Column, sample_docs: int, sample_runs: int
) -> list[tuple[str, bytes, float]]:
    """The bounded sample: of each language the documents with the smallest id hashes, and their most frequent runs."""
    labelled = docs.filter(learns & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("pick"))
    # Only hashes below a bound that lets some four times the sample pass are put in order, however many tasks there are.
    found = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.least(F.lit(1.0), F.lit(4.0 * max(sample_docs, 64)) / F.col("rows"))
    bound = (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("bound")
    first = Window.partitionBy("lang").orderBy("pick", "id")
    chosen = (
        ids.join(found.select("lang", bound), "lang")
        .filter(F.col("pick") <= F.col("bound"))
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= sample_docs)
        .select("id")
        .distinct()
    )
    texts = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    # At most ``sample_docs`` ids per language. While these are few, they are broadcast and no text is shuffled.
    few = chosen.withColumnRenamed("id", "chosen")
    if found.count() * sample_docs <= BROADCAST_IDS:
        few = F.broadcast(few)
    texts = texts.join(few, F.col("id").eqNullSafe(F.col("chosen")), "left_semi")
    runs = texts.select("lang", F.explode(F.expr(f"regexp_extract_all(lower(text), '(\\\\p{{L}}{{1,{RUN_LETTERS}}})', 1)")).alias("run"))
    often = Window.partitionBy("lang").orderBy(F.desc("count"), F.xxhash64("run"), "run")
    rows = (
        runs.groupBy("lang", "run")
        .count()
        .withColumn("n", F.row_number().over(often))
        .filter(F.col("n") <= sample_runs)
        .orderBy("lang", "n")
        .collect()
    )
    return [(r["lang"], r["run"].encode(), float(r["count"])) for r in rows]


class RunTable(dict):
    """Run of letters to its row in a matrix of summed distributions, with the number of bytes last."""

    def __init__(self, weights: dict[str, np.ndarray]):
        super().__init__()
        self.weights, self.classes = weights, len(weights["bias"])
        self.sums = np.zeros((1024, self.classes + 1), np.float32)
        self.fresh: list[bytes] = []

    def __missing__(self, run: str) -> int:
        self[run] = n = len(self)
        self.fresh.append(run.encode())
        return n

    def settle(self) -> None:
        """Run the network over the runs that are new."""
        begin = len(self) - len(self.fresh)
        if len(self) > len(self.sums):
            grown = np.zeros((max(len(self), 2 * len(self.sums)), self.classes + 1), np.float32)
            grown[:begin] = self.sums[:begin]
            self.sums = grown
        for places, codes in _by_length(self.fresh):
            for at in range(0, len(places), 4096):
                some = slice(at, at + 4096)
                self.sums[begin + places[some], :-1] = label_positions(self.weights, codes[:, some]).sum(axis=0)
                self.sums[begin + places[some], -1] = len(codes)
        self.fresh = []

    def documents(self, texts: Sequence[str]) -> np.ndarray:
        """Mean distribution over all bytes of each text's runs; zeros if it has none."""
        if len(self) > TABLE_RUNS:
            self.clear()
        found = [RUNS(t.lower()) for t in texts]
        places = [np.fromiter(map(self.__getitem__, runs), np.int64, len(runs)) for runs in found]
        self.settle()
        pooled = np.zeros((len(texts), self.classes))
        for i, at in enumerate(places):
            if len(at):
                total = self.sums[at].sum(axis=0, dtype=np.float64)
                pooled[i] = total[:-1] / total[-1]
        return pooled


def identify(
    docs: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_runs: int = SAMPLE_RUNS,
) -> DataFrame:
    """``(row, lang_pred, score)``: each row as a struct, its language and that language's share, 0 to 1.

    The network learns from rows where ``learns`` holds and text and language are not null: at most ``sample_docs``
    documents and ``sample_runs`` distinct runs of letters per language. Only the text decides a prediction.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn
    from. Ties go to the language that comes first in the alphabet. Null ids and repeated rows are rows like any other;
    an empty table gives an empty table. All columns are in ``row``, so none can clash with a name used here.
    """
    sample = training_runs(docs, id_col, text_col, lang_col, learns, sample_docs, sample_runs)
    languages = sorted({r[0] for r in sample})
    weights = train(sample, languages) if sample else None
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RunTable(weights) if weights else None
        for batch in batches:
            begin, size, block = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                block.append(text.as_py() or "")
                size += len(block[-1])
                if size < BLOCK and i < batch.num_rows - 1:
                    continue
                pooled = table.documents(block) if table is not None else np.zeros((len(block), 1))
                best, score = pooled.argmax(axis=1), pooled.max(axis=1)
                names = [languages[b] if s > 0 else UNDETERMINED for b, s in zip(best.tolist(), score.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(begin, len(block)), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))],
                    ["row", "lang_pred", "score"],
                )
                begin, size, block = i + 1, 0, []

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return map_batches(rows, run, schema)
