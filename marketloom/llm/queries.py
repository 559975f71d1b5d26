"""Registered queries opN_<name> and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import licenses, prefix_trie
from .decontamination import op1_decontamination
from .embedding_dedup import op11_embedding_dedup
from .html_extraction import op2_html_extraction
from .jaccard_join import op5_jaccard_join
from .language_id import op7_language_id
from .periodic_runs import op12_periodic_runs
from .secrets import op6_secrets
from .sentencepiece import op4_sentencepiece
from .toxicity import op10_toxicity
from .token_counts import op3_token_counts
from .vector_search import op8_top_k

QUERIES = {"op1_decontamination": op1_decontamination, "op2_html_extraction": op2_html_extraction, "op3_token_counts": op3_token_counts, "op4_sentencepiece": op4_sentencepiece, "op5_jaccard_join": op5_jaccard_join,
           "op6_secrets": op6_secrets, "op7_language_id": op7_language_id, "op8_top_k": op8_top_k, "op9_licenses": licenses.op9_licenses, "op10_toxicity": op10_toxicity,
           "op11_embedding_dedup": op11_embedding_dedup, "op12_periodic_runs": op12_periodic_runs, "op13_prefix_trie": prefix_trie.op13_prefix_trie}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Per document: words, hit words, items with an occurring window (expects tables `docs` and `benchmark`).
CONTAMINATION = rf"""
dw as (select doc_id, coalesce({_WORDS}, []) w from docs),
bw as (select item_id::varchar item_id, {_WORDS} w from benchmark where text is not null and item_id is not null),
win as (select item_id, unnest([w[i:i + least(len(w), 13) - 1] for i in range(1, greatest(len(w) - 12, 1) + 1)]) g from bw where len(w) > 0),
dg as (select doc_id, n, i, w[i:i + n - 1] g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, (select distinct len(g) n from win))),
occ as (select distinct doc_id, i, n, item_id from dg join win using (g)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from occ) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from occ group by doc_id),
con as (select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated from dw left join hit using (doc_id) left join its using (doc_id))"""

TOP_K = """with v as (select vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)) x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int "rank", vec_id, score from s)
select * from r where "rank" <= 10"""

SQL = {"op8_top_k": TOP_K, "op13_prefix_trie": prefix_trie.ORACLE, "op9_licenses": licenses.oracle(),
       "op1_decontamination": f"with docs as (select * from documents), {CONTAMINATION} select * from con"}
