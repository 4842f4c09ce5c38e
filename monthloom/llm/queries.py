"""The corpus operators as registered queries, and their SQL."""

from __future__ import annotations

from .op01_mix import OP1_SQL, op1_mix
from .op02_lines import OP2_SQL, op2_lines
from .op03_vectors import op3_vectors
from .op04_shard import op4_shard
from .op05_quality import op5_quality
from .op06_suffix import op6_suffix
from .op07_license import op7_license
from .op08_minhash import op8_minhash
from .op09_fingerprint import op9_fingerprint
from .op10_pack import op10_pack
from .op11_periodic import op11_periodic
from .op12_warc import OP12_SQL, op12_warc
from .op13_negatives import OP13_SQL, op13_negatives

QUERIES = {
    "op1_mix": op1_mix,
    "op2_lines": op2_lines,
    "op3_vectors": op3_vectors,
    "op4_shard": op4_shard,
    "op5_quality": op5_quality,
    "op6_suffix": op6_suffix,
    "op7_license": op7_license,
    "op8_minhash": op8_minhash,
    "op9_fingerprint": op9_fingerprint,
    "op10_pack": op10_pack,
    "op11_periodic": op11_periodic,
    "op12_warc": op12_warc,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL = {"op1_mix": OP1_SQL, "op2_lines": OP2_SQL, "op12_warc": OP12_SQL, "op13_negatives": OP13_SQL}
