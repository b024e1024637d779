"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from annalist.llm.decontaminate import op10_decontaminate
from annalist.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from annalist.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from annalist.llm.imatch import op11_imatch
from annalist.llm.language_id import op8_language_id
from annalist.llm.language_model import op5_language_model
from annalist.llm.minhash import op9_minhash
from annalist.llm.mixing import OP3_SQL, op3_mix
from annalist.llm.oracles import OP1_SQL, OP9_SQL, OP10_SQL, OP12_SQL
from annalist.llm.periodic_runs import op12_periodic_runs
from annalist.llm.suffix_dedup import op1_suffix_dedup
from annalist.llm.surrogates import op6_surrogates
from annalist.llm.token_store import op4_tokens
from annalist.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mix": op3_mix,
    "op4_tokens": op4_tokens,
    "op5_language_model": op5_language_model,
    "op6_surrogates": op6_surrogates,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_minhash": op9_minhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_imatch": op11_imatch,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {
    "op1_suffix_dedup": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op3_mix": OP3_SQL,
    "op7_warc": OP7_SQL,
    "op9_minhash": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
