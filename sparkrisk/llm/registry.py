"""Queries of the corpus operators and the SQL to check them against."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run
from sparkrisk.llm.decontaminate import op4_decontaminate
from sparkrisk.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from sparkrisk.llm.html_text import op8_html_text
from sparkrisk.llm.language_id import op5_language_id
from sparkrisk.llm.license_scan import OP6_SQL, op6_license_scan
from sparkrisk.llm.merkle_manifest import OP13_SQL, op13_merkle
from sparkrisk.llm.minhash import op11_minhash
from sparkrisk.llm.packing import op1_pack
from sparkrisk.llm.periodic_runs import op12_periodic_runs
from sparkrisk.llm.secret_scan import op10_secret_scan
from sparkrisk.llm.simhash import op2_simhash
from sparkrisk.llm.suffix_dedup import op3_suffix_dedup
from sparkrisk.llm.warc import OP7_SQL, op7_warc

CORPUS_QUERIES = {
    "op1_pack": op1_pack,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_warc": op7_warc,
    "op8_html_text": op8_html_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_minhash": op11_minhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle": op13_merkle,
    "pipeline": run,
}

CORPUS_ORACLE = {
    "op6_license_scan": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op13_merkle": OP13_SQL,
} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
