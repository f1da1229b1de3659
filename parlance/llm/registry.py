"""The corpus queries that the driver runs, and the SQL of those that SQL can express."""

from .bpe_chunks import op11_bpe
from .compaction import op12_compaction
from .dedup import OP2_SQL, op2_exact_dedup
from .embedding_dedup import op7_embedding_dedup
from .html_extract import op9_html_extract
from .language_id import op8_language_id
from .license_scan import op4_license_scan
from .mixing import op6_mixing
from .ngram_join import op1_ngram_jaccard
from .packing import op5_packing
from .prefix_trie import op13_prefix_trie
from .secret_scan import op3_secret_scan
from .url_filter import op10_url_filter

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_license_scan": op4_license_scan,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_html_extract": op9_html_extract,
    "op10_url_filter": op10_url_filter,
    "op11_bpe": op11_bpe,
    "op12_compaction": op12_compaction,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {"op2_exact_dedup": OP2_SQL}
