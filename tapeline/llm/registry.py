"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm.bpe import op7_bpe
from tapeline.llm.conversations import op12_conversations
from tapeline.llm.decontamination import op4_decontamination
from tapeline.llm.jaccard_join import op5_jaccard_join
from tapeline.llm.lattice import op8_lattice
from tapeline.llm.media import op6_media
from tapeline.llm.oracles import CONVERSATIONS_SQL, SPELLING_SQL
from tapeline.llm.quality import op3_quality
from tapeline.llm.repeats import op2_repeats
from tapeline.llm.secrets_scan import op1_secrets
from tapeline.llm.sharding import op13_sharding
from tapeline.llm.spelling import op11_spelling
from tapeline.llm.token_files import op9_token_files
from tapeline.llm.toxicity import op10_toxicity
from tapeline.shipping import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: ready(query)
    for name, query in {
        "op1_secrets": op1_secrets,
        "op2_repeats": op2_repeats,
        "op3_quality": op3_quality,
        "op4_decontamination": op4_decontamination,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_media": op6_media,
        "op7_bpe": op7_bpe,
        "op8_lattice": op8_lattice,
        "op9_token_files": op9_token_files,
        "op10_toxicity": op10_toxicity,
        "op11_spelling": op11_spelling,
        "op12_conversations": op12_conversations,
        "op13_sharding": op13_sharding,
    }.items()
}

ORACLE: dict[str, str] = {"op11_spelling": SPELLING_SQL, "op12_conversations": CONVERSATIONS_SQL}
