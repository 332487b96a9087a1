"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into phrases, each the
longest match that the automaton yields; few phrases mean that the text looks like the language. With c phrases over
n letters and blanks, and m characters learned, a language costs c * log2(m) / n bits per character, and the cheapest
one wins. Whole texts are parsed, in lanes of ``LANE`` characters that advance together as one NumPy array; a phrase ends with
its lane, so a text has at most one phrase more per ``LANE`` characters than an unbroken parse.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mirrortab.llm.arrays import balanced
from mirrortab.llm.registry import query, table
from mirrortab.llm.tables import held

UNKNOWN = "und"
LANE = 1024
#: Bounds of the labelled sample: languages (those with most rows), rows per language, characters of a row, characters of all languages together.
MOST_LABELS = 256
SAMPLE_ROWS = 64
ROW_CHARS = 4096
TOTAL_CHARS = 262_144
FOLDS, HELD_FOLD = 5, 0
RANKED_PARTS = 64

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def learned_rows(df: DataFrame, text: str, label: str, rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS,
                 labels: int = MOST_LABELS) -> list[tuple[str, str]]:
    """(label, text) of at most ``rows`` different texts per label, those with the smallest hashes of the text.

    At most ``labels`` labels are learned, those with most rows. Only hashes are ranked; the texts of the chosen ones are then fetched, cut to ``row_chars`` characters.
    Rows without a label or without a text teach nothing.
    """
    from pyspark.sql import Window
    known = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("label"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    # A label may hold most rows: its hashes are ranked in parts first, and the first of each part once more.
    part = F.pmod(F.col("h"), F.lit(RANKED_PARTS)).alias("part")
    within = F.row_number().over(Window.partitionBy("label", "part").orderBy("h"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    copies = known.groupBy("label", "h").agg(F.count(F.lit(1)).alias("copies"))
    common = copies.groupBy("label").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "label").limit(labels)
    firsts = copies.select("label", "h", part).withColumn("rank", within).where(F.col("rank") <= rows).join(F.broadcast(common.select("label")), "label")
    cut = firsts.withColumn("rank", rank).where(F.col("rank") <= rows).groupBy("label").agg(F.max("h").alias("cut"))
    cuts = {r["label"]: r["cut"] for r in cut.collect()}
    if not cuts:
        return []
    limit = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
    chosen = (known.where(F.col("h") <= F.try_element_at(limit, F.col("label")))
              .select("label", "h", F.substring("text", 1, row_chars).alias("text")).groupBy("label", "h").agg(F.min("text").alias("text")))
    return [(r["label"], r["text"]) for r in sorted(chosen.collect(), key=lambda r: (r["label"], r["h"]))]


class Automaton:
    """Suffix automaton of a code sequence; state 0 is none, state 1 the root.

    Most states have one transition, which is kept as its symbol and target; only the others have a row in a table, as
    wide as the alphabet of the sequence itself.
    """

    def __init__(self, codes: np.ndarray, symbols: int):
        alphabet, codes = np.unique(codes, return_inverse=True)
        #: The sequence's own number of each symbol, one more than it has for symbols it lacks.
        self.own = np.full(symbols, len(alphabet), np.int32)
        self.own[alphabet] = np.arange(len(alphabet))
        codes, symbols = codes.tolist(), len(alphabet) + 1
        following, link, length = [{}, {}], [0, 0], [0, 0]
        last = 1
        for c in codes:
            now = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in following[p]:
                following[p][c] = now
                p = link[p]
            if p:
                q = following[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    twin = len(following)
                    following.append(dict(following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and following[p].get(c) == q:
                        following[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        self.symbols = symbols
        self.only, self.only_to, self.row = np.full(len(following), -1, np.int32), np.zeros(len(following), np.int32), np.zeros(len(following), np.int32)
        several = [s for s, moves in enumerate(following) if len(moves) > 1]
        table = np.zeros((len(several) + 1, symbols), np.int32)
        for r, s in enumerate(several, 1):
            self.row[s] = r * symbols
            table[r, list(following[s].keys())] = list(following[s].values())
        for s, moves in enumerate(following):
            if len(moves) == 1:
                self.only[s], self.only_to[s] = next(iter(moves.items()))
        self.table = table.reshape(-1)
        # Where no phrase goes on, one begins with the character; one never seen leads to state 0, where none goes on.
        self.fresh = np.zeros(symbols, np.int32)
        self.fresh[list(following[1].keys())] = list(following[1].values())

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.only, self.only_to, self.row, self.table, self.own))

    def phrases(self, columns: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Phrases of each lane; ``columns[j]`` holds character j of all lanes, of which the first ``live[j]`` have one."""
        state = np.zeros(columns.shape[1], np.int32)
        count = np.zeros(columns.shape[1], np.int64)
        for j in range(columns.shape[0]):
            n = live[j]
            if not n:
                break
            c, s = self.own[columns[j, :n]], state[:n]
            to = np.where(self.only[s] == c, self.only_to[s], self.table[self.row[s] + c])
            begins = to == 0
            count[:n] += begins
            state[:n] = np.where(begins, self.fresh[c], to)
        return count


class CrossParser:
    """Automata of all labels over one alphabet."""

    def __init__(self, sample: list[tuple[str, str]], total_chars: int = TOTAL_CHARS):
        texts: dict[str, list[str]] = {}
        for label, text in sample:
            texts.setdefault(label, []).append(text)
        self.labels = sorted(texts)
        seen: dict[str, int] = {}
        for t in (t for ts in texts.values() for t in ts):
            for ch in t.lower():
                if ch.isalpha():
                    seen[ch] = seen.get(ch, 0) + 1
        known = sorted(seen, key=lambda ch: (-seen[ch], ch))
        kind = np.min_scalar_type(len(known) + 1)
        self.codes = np.where(letters(), len(known) + 1, 0).astype(kind)
        for i, ch in enumerate(known):
            self.codes[ord(ch)] = i + 1
        self.symbols = len(known) + 2
        share = total_chars // max(1, len(self.labels))
        self.automata, self.cost = [], []
        for label in self.labels:
            joined = np.concatenate([np.append(self.coded(t), 0) for t in texts[label]])[:share]
            self.automata.append(Automaton(joined, self.symbols))
            self.cost.append(np.log2(max(2, len(joined))))

    def coded(self, text: str) -> np.ndarray:
        return self.collapsed(self.codes[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)], None)[0]

    @staticmethod
    def collapsed(codes: np.ndarray, owner: np.ndarray | None):
        """Runs of non-letters as one blank."""
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        if owner is not None:
            keep[1:] |= owner[1:] != owner[:-1]
        return codes[keep], None if owner is None else owner[keep]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Label and score of each text; UNKNOWN without a letter or without anything learned."""
        docs = len(texts)
        lowered = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), np.int64, docs)
        points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
        codes, owner = self.collapsed(self.codes[points], np.repeat(np.arange(docs), sizes))
        lengths = np.bincount(owner, minlength=docs) if docs else np.zeros(0, np.int64)
        with_letter = np.zeros(docs, bool)
        with_letter[owner[codes != 0]] = True
        if not self.labels or not with_letter.any():
            return [UNKNOWN] * docs, np.zeros(docs)
        per_doc = -(-lengths // LANE)
        lane_doc = np.repeat(np.arange(docs), per_doc)
        in_doc = np.arange(len(lane_doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        begin = np.repeat(np.cumsum(lengths) - lengths, per_doc) + in_doc * LANE
        size = np.minimum(LANE, lengths[lane_doc] - in_doc * LANE)
        order = np.argsort(-size, kind="stable")
        lane_doc, begin, size = lane_doc[order], begin[order], size[order]
        width = int(size.max())
        live = np.searchsorted(-size, -np.arange(width), side="left")
        padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
        columns = padded[begin[None, :] + np.arange(width)[:, None]].astype(np.int32)
        bits = np.empty((len(self.labels), docs))
        for k, automaton in enumerate(self.automata):
            count = np.bincount(lane_doc, automaton.phrases(columns, live), docs)
            bits[k] = count * self.cost[k] / np.maximum(lengths, 1)
        best = bits.argmin(axis=0)
        lowest = bits.min(axis=0)
        score = np.ones(docs)
        if len(self.labels) > 1:
            score = 1 - lowest / np.partition(bits, 1, axis=0)[1]
        names = [self.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), with_letter.tolist())]
        return names, np.where(with_letter, score, 0.0)


def _parser(sample: list[tuple[str, str]], total_chars: int) -> CrossParser:
    """One per worker process."""
    return held(("language", hash((tuple(sample), total_chars))), lambda: CrossParser(sample, total_chars))


def predict(df: DataFrame, text: str, sample: list[tuple[str, str]], total_chars: int = TOTAL_CHARS,
            prediction: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """``df`` with the columns ``prediction`` (string) and ``score`` (double from 0 to 1, the lead over the next language).

    Rows are judged one by one, by their whole texts: repeated rows get the same answer; a null, empty or letterless
    text is ``und`` with score 0; with nothing learned everything is ``und``; with one language every text with a letter is that one, with
    score 1. Equal costs go to the label that sorts first. Columns of those two names are replaced, others pass through.
    """
    kept = [c for c in df.columns if c not in (prediction, score) and (c != text or keep_text)]
    shipped = df.sparkSession.sparkContext.broadcast(sample)
    body = df.select(F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)]).alias("kept"), df[f"`{text}`"].alias("text"))

    def run(batches):
        parser = _parser(shipped.value, total_chars)
        for batch in batches:
            for part in balanced(batch, "text"):
                names, scores = parser.judge([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["kept", "p", "s"])

    out = body.mapInArrow(run, f"kept {body.schema['kept'].dataType.simpleString()}, p string, s double")
    return out.select(*[F.col("kept").getField(f"c{i}").alias(c) for i, c in enumerate(kept)],
                      F.col("p").alias(prediction), F.col("s").alias(score))


def learn(docs: DataFrame) -> list[tuple[str, str]]:
    """The labelled sample of ``documents``, without the held-out fold and without rows of null doc_id."""
    return learned_rows(docs.where(fold(F.col("doc_id")) != HELD_FOLD), "text", "lang")


@query("op2_language")
def op2_language(spark, folder):
    """doc_id, held_out, lang_pred, score of every document; a null doc_id is neither learned from nor held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_FOLD, F.lit(False)).alias("held_out")
    judged = predict(docs.select("doc_id", held, "text"), "text", learn(docs), keep_text=False)
    return judged.select("doc_id", "held_out", "lang_pred", "score")
