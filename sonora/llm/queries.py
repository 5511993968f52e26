"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .codes import OP11_SQL, op11_codes
from .html import op7_html
from .language import op6_language
from .licenses import OP4_SQL, op4_licenses
from .mixing import op1_mix
from .neardup import op8_neardup
from .neighbours import op2_neighbours
from .packing import op9_pack
from .quality import op5_quality
from .rules import ABLATIONS_SQL, OP3_SQL, op3_rules, rule_ablations
from .sharding import op10_shard
from .toxicity import op12_toxicity
from .trie import OP13_SQL, op13_trie

QUERIES = {f.__name__: f for f in (op1_mix, op2_neighbours, op3_rules, op4_licenses, op5_quality, op6_language, op7_html, op8_neardup, op9_pack, op10_shard, op11_codes, op12_toxicity, op13_trie, rule_ablations)}
ORACLES = {"op3_rules": OP3_SQL, "op4_licenses": OP4_SQL, "rule_ablations": ABLATIONS_SQL, "op11_codes": OP11_SQL, "op13_trie": OP13_SQL}
