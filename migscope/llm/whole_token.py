"""Token counts: the whole-token shortcut.

``proven`` finds, offline and once a session, which vocabulary strings encode alone as one
token: each candidate is given to the library and must come back as that one id.  A text is
normalised and cut into pre-tokens; a pre-token that is proven counts one without any
merging, and only the rest is merged by the library's model (and remembered, in bounded
memory).  Texts with a special string, or with control characters, symbols or letters
beyond Latin-1 (whose classes may differ between regex engines), go to the library whole.

Cases: null and empty texts have no tokens; null ids, repeated rows and long texts are counted
like any other row; an empty table gives no rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.text import column, kept_by_worker, pieces, tokenizer_path

LIMIT = 2048
CACHE = 400_000
#: Fixed value: the pre-token pattern of the word-end vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def proven(path: str) -> list[str]:
    """Strings of the vocabulary (plain lower-case ASCII words) that the library encodes alone as one token."""
    tok = load(path)
    named = [(s[: -len(END_OF_WORD)], i) for s, i in tok.get_vocab().items() if s.endswith(END_OF_WORD)]
    named = [(s, i) for s, i in named if s.isascii() and s.isalpha() and s.islower()]
    got = tok.encode_batch_fast([s for s, _ in named], add_special_tokens=False)
    return sorted(s for (s, i), e in zip(named, got, strict=True) if e.ids == [i])


class Counter:
    """Tokens of whole texts."""

    def __init__(self, path: str, whole: list[str]):
        import regex
        self.tok = load(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.find = regex.compile(PRETOKEN).findall
        self.simple = re.compile("[a-z\\u00df-\\u00f6\\u00f8-\\u00ff]+|[0-9]|[^a-z\\u00df-\\u00f6\\u00f8-\\u00ff0-9\\s]+").findall
        # Characters whose class or white-space nature the two regex engines may see differently.
        self.beyond = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xbf\\u0100-\\U0010ffff]").search
        self.whole = dict.fromkeys(whole, 1)
        self.cache = dict(self.whole)
        self.old: dict[str, int] = {}

    def _merged(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            mapped = word if word.isascii() else self.tok.pre_tokenizer.pre_tokenize_str(word)[0][0]
            n = len(self.tok.model.tokenize(mapped))
        if len(self.cache) >= CACHE:
            self.old, self.cache = self.cache, dict(self.whole)
        self.cache[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.beyond(text) or any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        text = text.lower()
        words = self.find(text) if "'" in text else self.simple(text)
        found = list(map(self.cache.get, words))
        if None in found:
            return sum([self._merged(w) if n is None else n for w, n in zip(words, found, strict=True)])
        return sum(found)


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; no shuffle.  The proven strings are a
    part of the vocabulary file, which bounds what each task gets."""
    path = tokenizer_path(tokenizer)
    whole = docs.sparkSession.sparkContext.broadcast(proven(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(f"counter {path}", lambda: Counter(path, whole.value))
        for batch, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([counter.count(t.decode()) for t in texts], pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(counted, "id long, n_bytes long, n_tokens long") \
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
