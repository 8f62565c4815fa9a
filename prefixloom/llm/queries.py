"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from prefixloom.llm import decontamination, licenses, merkle, mtree, secrets, warc
from prefixloom.llm.packing import op2_packing
from prefixloom.llm.quality import op10_quality
from prefixloom.llm.repeats import op3_repeats
from prefixloom.llm.sentencepiece_codec import op4_sentencepiece
from prefixloom.llm.simhash import op7_simhash
from prefixloom.llm.toxicity import op5_toxicity
from prefixloom.llm.whitening import op13_whitening

QUERIES = {"op1_licenses": licenses.op1_licenses, "op2_packing": op2_packing, "op3_repeats": op3_repeats, "op4_sentencepiece": op4_sentencepiece, "op5_toxicity": op5_toxicity, "op6_secrets": secrets.op6_secrets, "op7_simhash": op7_simhash, "op8_decontamination": decontamination.op8_decontamination, "op9_warc": warc.op9_warc, "op10_quality": op10_quality, "op11_mtree": mtree.op11_mtree, "op12_merkle": merkle.op12_merkle, "op13_whitening": op13_whitening}
ORACLE: dict[str, str] = {"op1_licenses": licenses.oracle(), "op6_secrets": secrets.oracle(), "op8_decontamination": decontamination.ORACLE, "op9_warc": warc.ORACLE, "op11_mtree": mtree.ORACLE, "op12_merkle": merkle.oracle()}
