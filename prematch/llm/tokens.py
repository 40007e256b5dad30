"""Token counts of whole texts: Arrow functions encode batches of about equal bytes and give back lengths only.

A text longer than ``PART`` characters is split where no token can lie across
the cut, so a task never encodes more than a batch at once, however long a
document is. The ids never leave the worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a part of a long text, and of a batch of parts.
PART, BATCH = 1 << 17, 1 << 19
#: One blank between two characters that are no white space.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Texts around a cut, on which a tokenizer has to agree with itself before any text is cut for it.
_PROBES = ("a b", "Ab's don't", "x9 8y", "é ü", "(a) [b]", "猫 犬", "a. B", "<| |>", "ﬁ ǆ", "_ _a", "й́ ё", "'s 't")
_loaded: dict[str, tuple[Callable[[list[str]], list[int]], str | None]] = {}


def _tokenizers(path: str) -> tuple[Callable, bool]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
    from tokenizers import Tokenizer

    engine = Tokenizer.from_file(path)
    engine.no_truncation()
    engine.no_padding()
    added = engine.get_added_tokens_decoder().values()
    plain = not any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in added)
    return lambda texts: [e.ids for e in engine.encode_batch_fast(texts, add_special_tokens=False)], plain


def _sentencepiece(path: str) -> tuple[Callable, bool]:
    from sentencepiece import SentencePieceProcessor

    engine = SentencePieceProcessor(model_file=path)
    pieces = (engine.id_to_piece(i) for i in range(engine.get_piece_size()))
    plain = not any("▁" in p.lstrip("▁") for p in pieces)
    return lambda texts: engine.encode(texts, num_threads=1), plain


def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], str | None]:
    """A function from texts to their numbers of tokens, and what the right side of a cut begins with (None: texts stay whole).

    The blank at a cut either opens the right side's first token or belongs to
    the mark that a text's first word has anyway; the probes tell which.
    """
    if path not in _loaded:
        encode, plain = (_sentencepiece if path.endswith(".model") else _tokenizers)(path)

        def agrees(lead: str) -> bool:
            cuts = [p.split(" ") for p in _PROBES]
            return all(w == a + b for w, a, b in zip(*map(encode, (list(_PROBES), [a for a, _ in cuts], [lead + b for _, b in cuts]))))

        lead = next((x for x in (" ", "") if plain and agrees(x)), None)
        _loaded[path] = (lambda texts: [len(x) for x in encode(texts)]), lead
    return _loaded[path]


def parts(text: str, lead: str | None, size: int = PART) -> Iterator[str]:
    """The text, a long one cut at blanks between which no token lies; without such blanks it stays whole."""
    at = 0
    while lead is not None and len(text) - at > size and (cut := _BLANK.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end() - len(lead)
    yield text[at:]


def count_tokens(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", part: int = PART, batch: int = BATCH
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, one row for each row of ``docs``.

    ``tokenizer`` is a file that every executor has: ``.json`` for
    ``tokenizers``, ``.model`` for ``sentencepiece``. No begin, end or other
    special token is added, nothing is cut off or filled up; strings of special
    tokens inside a text count as the library reads them. Null and empty texts
    have 0 bytes and 0 tokens. Rows are judged one by one: null and repeated
    ids stay as they are, other columns are ignored, an empty table gives no
    rows. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, lead = _counter(tokenizer)
        for b in batches:
            total = np.zeros(b.num_rows, np.int64)
            at: list[int] = []
            held: list[str] = []
            chars = 0
            for i, t in enumerate(b.column("text")):
                for p in parts(t.as_py(), lead, part):
                    at.append(i)
                    held.append(p)
                    chars += len(p)
                    if chars >= batch:
                        np.add.at(total, at, count(held))
                        at, held, chars = [], [], 0
            if held:
                np.add.at(total, at, count(held))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
