"""SentencePiece encoding and decoding of BPE models by vectorised merge rounds.

A text becomes a flat numpy array of symbols (one for each character, after the dummy space in front),
cut into words where no piece of the vocabulary can reach across. In each round every word looks up the
rank of all its neighbouring pairs, takes the smallest, and merges its leftmost occurrence, all words at
once; merged symbols are compacted away, pairs beside them are looked up anew, and words without a pair leave. One merge a word and round gives
exactly the library's order. Words are encoded once for each batch; short ones are kept in a cache of bounded bytes. Words of
over ``LONG_WORD`` characters (text without spaces), where rounds would cost the square of their length,
take the same merges from a heap. Characters without a piece become byte pieces.

Decoding joins the pieces' bytes, drops the dummy space and replaces each invalid byte by U+FFFD.

A null or empty text has no ids and decodes to the empty text; repeated rows are encoded each; other
columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, trim_memory

#: Characters of a word from which a heap replaces the rounds; bytes that the cache of a worker takes, and characters of the longest word in it.
LONG_WORD = 400
CACHE_BYTES = 32_000_000
CACHED_WORD = 64
#: Bytes of a cached word besides its characters and ids: a place in the table and the heads of two objects.
ENTRY_BYTES = 190
#: Characters that one output batch holds at least.
BATCH_CHARS = 2_000_000
NO_PAIR = np.iinfo(np.int32).max


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("fffd_each_byte", _each_byte)


class PieceModel:
    """The vocabulary of a model file as arrays: symbols, ranked pairs, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(size)]
        self.table: list[bytes] = []
        self.byte_ids = [0] * 256
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                self.table.append(" ⁇ ".encode())
            else:
                self.table.append(piece.replace("▁", " ").encode() if plain[i] else b"")
        vocab = {piece.replace("▁", " "): i for i, piece in enumerate(pieces) if plain[i]}
        self.vocab = vocab
        self.symbols = dict(vocab)
        for piece in vocab:
            for c in piece:
                self.symbols.setdefault(c, size + len(self.symbols) - len(vocab))
        self.width = size + len(self.symbols) - len(vocab) + 1
        self.unknown = self.width - 1  # stands for every character that no piece has
        self.code_points = np.full(0x110000, self.unknown, dtype=np.int64)
        for c, symbol in self.symbols.items():
            if len(c) == 1:
                self.code_points[ord(c)] = symbol
        score = {i: sp.get_score(i) for i in vocab.values()}
        place = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, i in vocab.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (place[score[i]], i)
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int32), NO_PAIR)
        self.merged = np.append(np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int32), -1)
        reach = any(re.search("[^ ] ", p) for p in vocab)
        lines = any("\n" in p for p in vocab)
        self.words = re.compile(r"(?s).+" if reach else r"(?s) *[^ ]+| +" if lines else r" *[^ \n]+| +|\n")
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        self.decimals = [b"%d," % i for i in range(size)]

    def _ids(self, symbols: list[int], text: str) -> bytes:
        """Symbols that are no piece (single characters) become the ids of their bytes."""
        if max(symbols) < len(self.table):
            return np.array(symbols, dtype=np.int32).tobytes()
        out, at = [], 0
        for s in symbols:
            if s < len(self.table):
                out.append(s)
                at += len(self.table[s].decode())
            else:
                out += [self.byte_ids[b] for b in text[at].encode("utf-8", "replace")]
                at += 1
        return np.array(out, dtype=np.int32).tobytes()

    def _heap(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, width, heap = self.pairs, self.width, []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (hit := pairs.get(symbols[i] * width + symbols[j])):
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s in symbols if s >= 0]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes of int32."""
        get, unknown = self.symbols.get, self.unknown
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._ids(self._heap([get(c, unknown) for c in w]), w)
            else:
                short.append(i)
        if not short:
            return out
        text = "".join([words[i] for i in short])
        sym = self.code_points[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        last = len(self.keys) - 1  # stands for no pair
        pair = np.full(len(sym), last)
        pair[:-1] = np.where(word[1:] == word[:-1], self._pairs(sym[:-1], sym[1:]), last)
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(start, len(sym)))
            rank = self.ranks[pair]
            least = np.minimum.reduceat(rank, start)
            done = least == NO_PAIR
            if done.any():
                ready = sym.astype(np.int32)
                raw, pieces = ready.tobytes(), np.maximum.reduceat(ready, start)[done] < len(self.table)
                for s, n, plain in zip(start[done].tolist(), length[done].tolist(), pieces.tolist()):
                    i = short[word[s]]
                    out[i] = raw[4 * s : 4 * (s + n)] if plain else self._ids(ready[s : s + n].tolist(), words[i])
            best = np.flatnonzero((rank == np.repeat(least, length)) & (rank != NO_PAIR))
            if not len(best):
                break
            of = word[best]
            best = best[np.concatenate(([True], of[1:] != of[:-1]))]
            sym[best] = self.merged[pair[best]]
            keep = np.repeat(~done, length)
            keep[best + 1] = False
            at = np.cumsum(keep)[best] - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            # only the pairs on both sides of a merged symbol are new
            after, before = at[at + 1 < len(sym)], at[at > 0]
            pair[at] = last
            pair[after] = np.where(word[after + 1] == word[after], self._pairs(sym[after], sym[after + 1]), last)
            pair[before - 1] = np.where(word[before - 1] == word[before], self._pairs(sym[before - 1], sym[before]), last)
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of symbols in the sorted keys; the last place where they are none."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes of int32."""
        split = [self.words.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        cache = self.cache
        used = set().union(*split)
        ids = {w: cache[w] for w in used if w in cache}
        again = list(ids)
        new = [w for w in used if w not in ids]
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            ids.update(zip(some, self.merge_words(some)))
        out = [b"".join(map(ids.__getitem__, words)) for words in split]
        self._remember(ids, new, again)
        return out

    def _remember(self, ids: dict[str, bytes], new: list[str], again: list[str]) -> None:
        """Short new words go into the cache; a full one starts anew with the words that were found in it just now, half of it at most."""
        cache = self.cache
        for w in new:
            if len(w) > CACHED_WORD:
                continue
            size = ENTRY_BYTES + 2 * len(w) + len(ids[w])
            if self.cached + size > CACHE_BYTES:
                cache.clear()
                self.cached = 0
                for x in again:
                    if self.cached < CACHE_BYTES // 2:
                        cache[x] = ids[x]
                        self.cached += ENTRY_BYTES + 2 * len(x) + len(ids[x])
            cache[w] = ids[w]
            self.cached += size

    def decode(self, ids) -> str:
        table = self.table
        out = b"".join([table[i] for i in ids])
        first = next((table[i] for i in ids if table[i]), b"")
        return (out[1:] if first.startswith(b" ") else out).decode("utf-8", "fffd_each_byte")


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


#: What ``encode`` can add, by name.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def _outputs(model: PieceModel, ids: list[bytes], wanted: list[str]) -> list[pa.Array]:
    flat = np.frombuffer(b"".join(ids), dtype=np.int32)
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    found: dict[str, pa.Array] = {"n_tokens": pa.array(np.diff(offsets).astype(np.int64))}
    if "ids" in wanted:
        found["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    texts, digests, of_texts = [], [], []
    for x in ids:
        row = np.frombuffer(x, dtype=np.int32).tolist()
        if "ids_sha256" in wanted:
            digests.append(hashlib.sha256(b"".join([model.decimals[i] for i in row])[:-1]).hexdigest())
        if "decoded" in wanted or "decoded_sha256" in wanted:
            text = model.decode(row)
            of_texts.append(hashlib.sha256(text.encode()).hexdigest())
            if "decoded" in wanted:
                texts.append(text)
    found |= {"decoded": pa.array(texts, pa.string()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(of_texts, pa.string())}
    return [found[name] for name in wanted]


def _encode_batches(path: str, keep: int, names: list[str], wanted: list[str]):
    def run(batches):
        model = load(path)
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                texts, held = [], 0
                while i + len(texts) < batch.num_rows and held < BATCH_CHARS:
                    texts.append(batch.column(keep)[i + len(texts)].as_py())
                    held += len(texts[-1] or "")
                columns = batch.slice(i, len(texts)).columns[:keep] + _outputs(model, model.encode(texts), wanted)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                i += len(texts)
        trim_memory()

    return run


def encode(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, decode: bool = True, outputs: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (default all but the text), ``ids`` (array of int) and, if asked, ``decoded``; or the ``outputs`` named, of ``OUTPUTS``.

    Clashing columns of the input of those names are replaced. The text doesn't come back from the workers.
    """
    wanted = outputs or (["ids", "decoded"] if decode else ["ids"])
    keep = [c for c in (df.columns if keep is None else keep) if c not in (*wanted, "ids", "decoded", text_col)]
    ahead = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([*ahead.schema.fields[:-1], *[T.StructField(name, OUTPUTS[name]) for name in wanted]])
    return ahead.mapInArrow(_encode_batches(model_path, len(keep), [*keep, *wanted], wanted), out)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Number of ids and digests of ids and decoded text.
DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), outputs=DIGESTS)
