"""SentencePiece BPE encoding by a table of last tokens, and decoding.

For each prefix of a text its BPE encoding has one last token, and a token is that one if it ends the prefix and is
compatible with the last token of the prefix before it: merging the two tokens' characters gives just these two. So an
automaton's matches are tried at each place, one fits, and the ids are read off backwards. Compatibility of a pair is
worked out by merging once and kept.

No piece of such a model has a space mark after another character, so a text falls into runs of space marks with the
characters up to the next one; each run is encoded once and kept.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import table

MARK = "▁"
CACHE_RUNS = 250_000  # runs kept by a worker, twice over, of CACHED_LENGTH characters at most
CACHED_LENGTH = 64
CACHE_PAIRS = 2_000_000


class Runs(dict):
    """Runs with their ids and these as text: a missing one is taken from the dictionary before this one, or worked out."""

    def __init__(self, encoder, before):
        super().__init__()
        self.encoder, self.before = encoder, dict(before)

    def __missing__(self, run):
        got = self.before.get(run)
        if got is None:
            ids = tuple(self.encoder.run_ids(run))
            got = (ids, ",".join(map(str, ids)))
        if len(run) <= CACHED_LENGTH:
            self[run] = got
        return got


class PieceEncoder:
    """Encodes and decodes as the sentencepiece library does with a BPE model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.lib
        self.piece, self.score, self.byte = {}, {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[i], self.score[p] = p, (sp.get_score(i), i)
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece of this model has a space mark after another character")
        self.chars = {p for p in self.score if len(p) == 1}
        self.spaces = not any(c in p for p in self.score for c in "\n")
        self.auto = ahocorasick.Automaton()
        for i, p in self.piece.items():
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self.pairs, self.hot = {}, Runs(self, {})

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s[0] > best):
                    best, at = s[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether b can follow a; a = -1: whether b can come first."""
        key = (a << 20) | b if a >= 0 else ~b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            right = self.piece[b]
            known = self.pairs[key] = self.merge(right) == [right] if a < 0 else self.merge(self.piece[a] + right) == [self.piece[a], right]
        return known

    def known_chars(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n = len(text)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (length, i) in self.auto.iter(text):
            e = end + 1
            if size[e]:
                continue
            start = e - length
            if start and not size[start]:
                continue
            if self.compatible(last[start] if start else -1, i):
                last[e], size[e] = i, length
        out = []
        while n:
            if not size[n]:
                raise AssertionError(f"no last token at {n} of {text!r}")
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def run_ids(self, run: str) -> list[int]:
        """Ids of a run; characters that no piece has become their bytes."""
        if self.chars.issuperset(run):
            return self.known_chars(run)
        out = []
        for known, part in itertools.groupby(run, self.chars.__contains__):
            part = "".join(part)
            out += self.known_chars(part) if known else [self.byte[b] for b in part.encode("utf-8", "replace")]
        return out

    def runs(self, text: str) -> list[str]:
        """The runs of a text, the first with the space mark that the library puts before a text."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        pieces = []
        # A line end that no piece has can't be merged over: it is a run of its own.
        for k, line in enumerate(marked.split("\n") if self.spaces else [marked]):
            if k:
                pieces.append("\n")
            if not line:
                continue
            words = line.split(MARK)
            if words[0]:
                pieces.append(words[0])
            marks = 0
            for w in words[1:]:
                marks += 1
                if w:
                    pieces.append(MARK * marks + w)
                    marks = 0
            if marks:
                pieces.append(MARK * marks)
        return pieces

    def encode_with_text(self, text: str) -> tuple[list[int], str]:
        """Ids of a text, and the same as decimal numbers joined by commas."""
        if len(self.hot) > CACHE_RUNS:
            self.hot = Runs(self, self.hot)
        got = list(map(self.hot.__getitem__, self.runs(text)))
        return list(itertools.chain.from_iterable(g[0] for g in got)), ",".join([g[1] for g in got])

    def encode(self, text: str) -> list[int]:
        return self.encode_with_text(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@functools.lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process, with the runs that its earlier tasks have met."""
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with ``with_ids`` the ids and the decoded text.

    A null text is empty: no ids and an empty decoded text. Rows are handled one by one, so repeated rows and null ids
    are only carried along.
    """

    def run(batches):
        import pandas as pd

        enc = piece_encoder(model_path)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                ids, said = enc.encode_with_text(t if isinstance(t, str) else "")
                back = enc.decode(ids) if ids else ""
                row = [len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()]
                rows.append(row + [ids, back] if with_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else []))
            out.insert(0, "doc_id", pd.array(pdf["doc_id"], "Int64"))
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of ``documents`` as digests."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
