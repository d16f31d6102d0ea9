"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text accepts exactly that text's substrings. A document is cut
greedily into longest matches ("phrases"); a language whose text resembles the document needs few of them. The
phrase count times log2 of the reference length, per symbol, estimates the cross entropy, and the language with
the least wins. Workers walk many documents in step through one table of transitions, a symbol at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import pieces, small_batches, table

UNKNOWN = "und"
#: The fit's bounds, in labelled rows: documents drawn for a language, and pieces of their texts. A text is cut at line ends,
#: and lines at spaces, into pieces of PIECE characters at most; every piece of every drawn text can be drawn. The first
#: piece of each document comes before any second one, as a text that is copied elsewhere, or is partly in another language, is
#: not to lend a language more than a few words where there are others.
SAMPLE_ROWS, SAMPLE_PIECES, PIECE = 500, 400, 240
#: Languages learned at most, those with most rows, and pieces of all of them together: where there are more than six
#: languages, each has an equal part of these.
MOST_LANGUAGES, ALL_PIECES = 64, 2_400
#: The score's steepness: evidence of more letters than this does not make it steeper, so that long texts keep
#: telling sure from unsure.
SURE_LETTERS = 40
#: Text bytes that a worker walks in step: the more, the less a step costs a text.
STEP_BYTES = 8 << 20
#: A text is parsed in stretches of so many symbols, each from its own start, so that a long text is walked like many
#: short ones. A stretch costs a language one phrase at most.
STRETCH = 16_384
#: Letters that have a symbol of their own, those that are most of some language's letters; all others share one.
ALPHABET = 60


def crc_mod3(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def automaton(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions [states, symbols] of the suffix automaton of codes; 0 is both the start and "none"."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in codes.tolist():
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.zeros((len(step), symbols), np.int32)
    for s, row in enumerate(step):
        for c, to in row.items():
            out[s, c] = to
    return out


class Model:
    """Automata of all languages in one table.

    table[state * symbols + symbol] is twice the next row's offset, plus one where a phrase ended before the symbol.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(k for k, v in texts.items() if v)
        letters: dict[str, float] = {}
        folded = {k: " ".join(texts[k]).lower() for k in self.languages}
        for t in folded.values():
            for ch in set(t):
                if ch.isalpha():
                    letters[ch] = max(letters.get(ch, 0.0), t.count(ch) / len(t))
        kept = sorted(letters, key=lambda ch: (-letters[ch], ch))[:ALPHABET]
        # 0: anything that is not a letter, runs as one; 1: a letter without a symbol of its own
        self.symbol = {ch: i + 2 for i, ch in enumerate(kept)}
        self.width = len(kept) + 2
        self.lut = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            if chr(i).isalpha():
                self.lut[i] = self.symbol.get(chr(i).lower()[:1], 1)
        rows, self.roots, self.cost = [], [], []
        base = 0
        for k in self.languages:
            codes = self.codes(folded[k])
            own = automaton(codes, self.width)
            # where no transition is, a phrase ends and the next starts at the root with the symbol; a symbol that
            # even the root lacks is a phrase of its own, in a last state that every symbol ends
            own = np.vstack([own, np.zeros((1, self.width), np.int32)])
            ended = own == 0
            own = np.where(ended, np.where(own[0] == 0, len(own) - 1, own[0]), own) + base
            ended[0] = False
            rows.append((own.astype(np.int64) * self.width * 2 + ended).astype(np.int32))
            self.roots.append(base * self.width)
            self.cost.append(np.log2(max(2, len(codes))))
            base += len(own)
        if base * self.width * 2 >= 1 << 31:
            raise ValueError("too many languages for one table: lower symbols")
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)

    def codes(self, text: str) -> np.ndarray:
        """The text's symbols, with one 0 for each run of other characters, none at either end."""
        raw = self.lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = raw > 0
        keep = word.copy()
        keep[1:] |= word[:-1]
        out = raw[keep]
        return out[:-1] if len(out) and out[-1] == 0 else out

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [texts, languages], symbols [texts])."""
        whole = [self.codes(t or "") for t in texts]
        sizes = np.array([len(c) for c in whole], np.int64)
        codes = [c[i : i + STRETCH] for c in whole for i in range(0, len(c), STRETCH)]
        of = np.repeat(np.arange(len(whole)), -(-sizes // STRETCH))
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        if not codes or not self.languages:
            return total, sizes
        np.add.at(total, of, self.stretches(codes))
        return total, sizes

    def stretches(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases [stretches, languages] of stretches that are not empty."""
        size = np.array([len(c) for c in codes], np.int64)
        out = np.zeros((len(codes), len(self.languages)), np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([codes[i] for i in order]).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(size[order])[:-1]])
        left = np.searchsorted(-size[order], -np.arange(int(size[order[0]])), "left")  # texts longer than each step
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(order), 1)
        ended = np.ones_like(state)  # the last phrase
        for i, n in enumerate(left.tolist()):
            if n < state.shape[1]:
                out[order[n : state.shape[1]]] = ended[:, n:].T
                state, ended = np.ascontiguousarray(state[:, :n]), np.ascontiguousarray(ended[:, :n])
            step = self.table.take(state + flat[at[:n] + i])
            ended += step & 1
            state = step >> 1
        out[order[: state.shape[1]]] = ended.T
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the share of certainty that the least cross entropy gets by softmax."""
        n, size = self.phrases(texts)
        bits = n * np.array(self.cost)
        out = []
        for row, length in zip(bits, size, strict=True):
            if not length or not len(row):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmin(row))  # ties: the first by name
            rate = row / length
            weight = np.exp2(-(rate - rate[best]) * min(int(length), SURE_LETTERS))
            out.append((self.languages[best], float(weight[best] / weight.sum())))
        return out


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, pieces: int = SAMPLE_PIECES) -> dict[str, list[str]]:
    """Pieces of labelled documents by language: of up to `rows` documents, those of least keyed hash, up to `pieces` pieces.

    Languages with many rows are first thinned by hash to about twice the bound, so no task ranks a whole language. Of the
    documents drawn all text is cut into pieces; which are taken is drawn by hash too. Only text and lang are used,
    besides the key that orders the draw.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return {}
    pieces = max(1, min(pieces, ALL_PIECES // len(sizes)))
    draw = F.pmod(F.xxhash64(F.lit("draw"), F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 2 * rows / r["n"] + 40 / r["n"]) * (1 << 30))))])
    few = known.select("lang", "doc_id", "text", draw.alias("draw")).where(F.col("draw") < F.coalesce(share[F.col("lang")], F.lit(0)))
    by_lang = W.Window.partitionBy("lang").orderBy("draw", "key")
    first = few.withColumn("key", F.xxhash64(F.lit(1), "text")).withColumn("rank", F.row_number().over(by_lang)).where(F.col("rank") <= rows)
    # a run of PIECE characters without a space is cut in the middle
    cut = F.filter(F.regexp_extract_all("text", F.lit(rf"[^\r\n]{{1,{PIECE}}}(?!\S)|[^\r\n]{{{PIECE}}}"), F.lit(0)), lambda x: x.rlike(r"\p{L}"))
    each = first.select("lang", "rank", F.explode(cut).alias("piece")).withColumn("at", F.xxhash64(F.lit("piece"), "rank", "piece"))
    own = each.withColumn("nth", F.row_number().over(W.Window.partitionBy("lang", "rank").orderBy("at", "piece"))).where(F.col("nth") <= pieces)
    kept = own.withColumn("order", F.row_number().over(W.Window.partitionBy("lang").orderBy("nth", "rank"))).where(F.col("order") <= pieces)
    out: dict[str, list[str]] = {r["lang"]: [] for r in sizes}
    for r in kept.orderBy("lang", "order").select("lang", "piece").collect():  # ALL_PIECES rows of PIECE characters at most
        out[r["lang"]].append(r["piece"])
    return out


def consistent(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """texts without those that the other half of the sample takes for another language: a mislabelled text would
    match its copies better than any language matches itself. A language keeps all where nothing would be left."""
    folds = [{k: v[i::2] for k, v in texts.items()} for i in (0, 1)]
    kept: dict[str, list[str]] = {k: [] for k in texts}
    for i in (0, 1):
        model = Model(folds[1 - i])
        if len(model.languages) < 2:
            return texts
        for k, own in folds[i].items():
            kept[k] += [t for t, (said, _) in zip(own, model.predict(own), strict=True) if said in (k, UNKNOWN) or k not in model.languages]
    return {k: kept[k] or v for k, v in texts.items()}


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, pieces: int = SAMPLE_PIECES) -> Model:
    """A model of the labelled sample, but for texts that contradict their label."""
    return Model(consistent(labelled_sample(docs, rows, pieces)))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score.

    `und` with score 0 where the text is null or has no letter, or where no language was learned; ties between
    languages go to the first by name; whatever other columns there are stay, but columns of those two names are
    replaced. A text of any length is walked whole, its stretches and the other texts of a batch in step: 10 MB take some
    seconds of one task.
    """
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")
    names = [*docs.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text, STEP_BYTES):
            got = held.value.predict(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod3() != 1).select("doc_id", "text", "lang"))
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod3() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def brute_force(model: Model, samples: dict[str, str], text: str) -> dict[str, int]:
    """Phrases by substring search in the sample texts, for tests."""
    out, codes = {}, bytes(model.codes(text).tolist())
    for k, sample in samples.items():
        ref, n, i = bytes(model.codes(sample).tolist()), 0, 0
        while i < len(codes):
            j, end = i + 1, min(len(codes), i - i % STRETCH + STRETCH)
            while j <= end and codes[i:j] in ref:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        out[k] = n
    return out

