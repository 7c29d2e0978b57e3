"""op13: all documents packed without padding."""

from __future__ import annotations

import public_tokenizers

from glyphlake.llm import packing
from glyphlake.llm.registry import query, table


@query("op13_packing")
def op13_packing(spark, sf_dir):
    p = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return p.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
