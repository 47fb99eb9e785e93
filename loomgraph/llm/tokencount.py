"""Token counts without ids: each distinct pre-token is tokenised once and joined to the documents that have it.

A pre-token here is a run of text between ASCII white space, which every tokenizer in use drops or takes as a boundary
(the normaliser turns white space into one space, and the split pattern keeps none). Text is lower-cased and a full
stop or comma behind a letter is cut off first where that provably changes nothing; this only makes pre-tokens rarer.

Nulls are empty texts: no bytes, no tokens. Repeated rows stay rows of their own; other columns don't matter.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import wordtable
from loomgraph.llm.common import doc_text
from loomgraph.plans.session import stored

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct pre-tokens given to the library at a time.
BATCH = 2000

_STOP = re.compile(rb"(?<=[a-z])[.,](?=[\x20\n])")
#: Marks that may join with an ASCII letter (U+0300 to U+037F), and special strings: such texts are left as they are.
_KEEP = re.compile(rb"[\xcc\xcd]|<\|")


def pre_tokens(text: bytes) -> list[bytes]:
    if _KEEP.search(text) is None:
        text = _STOP.sub(rb" \g<0>", text.lower())
    return text.split()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@functools.lru_cache(maxsize=2)
def _tokenizer(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """word binary, c long, n_tokens long: each distinct pre-token, its count in the corpus and its number of tokens."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        library = _tokenizer(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [w.decode("utf-8", "replace") for w in part.column(0).to_pylist()]
                n = [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["word", "c", "n_tokens"])

    return wordtable.count(docs, pre_tokens).mapInArrow(run, "word binary, c long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    texts = doc_text(docs)
    table = stored(pieces(texts, tokenizer), "pretokens")
    counted = wordtable.resolve(
        texts,
        pre_tokens,
        table,
        "n_tokens",
        term=float,
        term_sql=lambda v: v.cast("double"),
        missing=0.0,
        extra=(("n_bytes", "long"),),
        extras=lambda raw: [[len(t) for t in raw]],
    )
    n = F.round("total").cast("long")
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
