"""The same queries as plain SQL over the same tables."""

from __future__ import annotations

import math

from lodeway.functions import constants as K
from lodeway.functions import text as X
from lodeway.operators import analytics, lexical, rank
from lodeway.plans import queries as Q
from lodeway.sources.adapters import plain_sql

ENT, REL, FILES, META, DISK = (plain_sql(v) for v in ("entities", "relations", "files", "file_meta", "disk"))
KG = f"with entities as materialized ({ENT}), relations as materialized ({REL})"
CHUNKS = "chunks as (select doc_id as chunk_id, source || '/' || cast(doc_id as varchar) as file, text from documents)"


def quoted(names) -> str:
    return ", ".join("'" + str(n).replace("'", "''") + "'" for n in names)


TOKENS = (
    "list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_/\\\\.-]', ' ', 'g')), "
    "'[A-Za-zА-Яа-я0-9]+'), lambda t: length(t) > 1)"
)
TOKENIZED = (
    f"tokens as (select chunk_id, case when len(ts) > 0 then ts when trim(text) = '' then [] else [lower(trim(text))] end as ts "
    f"from (select chunk_id, text, {TOKENS} as ts from chunks))"
)
POSTED = f"{CHUNKS}, {TOKENIZED}, posted as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, len(ts) as dl, unnest(ts) as term from tokens) group by all)"


def bm25(query: str) -> str:
    terms: dict[str, int] = {}
    for t in query.lower().replace("-", " ").split():
        if len(t) > 1:
            terms[t] = terms.get(t, 0) + 1
    asked = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""{POSTED}, corpus as (select cast(count(*) as double) as n, avg(len(ts)) as avgdl from tokens),
    stats as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from (select term, count(*) as df from posted group by term), corpus),
    asked(term, m) as (values {asked}),
    bm as (select chunk_id, sum(m * (case when idf < 0 then {lexical.EPSILON} * (select avg(idf) from stats) else idf end)
      * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * ({1 - lexical.B} + {lexical.B} * dl / avgdl))) as bm25
      from posted join asked using (term) join stats using (term), corpus group by chunk_id)"""


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: cast({a}[i] as double) * cast({b}[i] as double)))"
DENSE = f"dense as (select e.vec_id as chunk_id, {DOT.format(a='e.embedding', b='q.embedding')} as dense from embeddings e, (select embedding from embeddings where vec_id = 0) q)"
PAIRS = f"pairs as (select a.vec_id as query, b.vec_id as neighbour, {DOT.format(a='a.embedding', b='b.embedding')} as score from embeddings a, embeddings b where a.vec_id <> b.vec_id)"
LEAF = "string_split(to_name, '.')[-1]"
USAGES = f"select file, from_name, relation, to_name from relations where to_name = '{Q.NAME}' or {LEAF} = '{Q.NAME}'"
FANOUT = "fanout as (select name, count(distinct file) as files from entities group by name)"
TEST_PART = "(file like '%tests%' or file like '%test%' or file like '%__tests__%' or file like '%spec%' or file like '%conftest.py%' or file like '%benches%')"
COVER = (
    f"keys as (select distinct unnest([to_name, {LEAF}]) as name, file, from_name from relations where {TEST_PART} and relation in ('calls','uses','instantiates','imports')), "
    f"production as (select file, name, type, name in (select name from keys) as covered from entities where type in ({quoted(K.COVERAGE_TYPES)}) and not {TEST_PART})"
)
CLONES = f"""{PAIRS}, near as (select query, neighbour, score from (select *, row_number() over (partition by query order by score desc, neighbour) as r from pairs) where r <= 20 and score >= 0.3),
  both_ as (select least(query, neighbour) as a, greatest(query, neighbour) as b, max(score) as score from near group by 1, 2),
  shapes as (select vec_id as id, list_transform(range(1, 9), lambda i: cast(i - 1 as varchar) || case when embedding[i] > 0 then '+' else '-' end) as shape from embeddings),
  clones as (select a, b, score, cast(len(list_intersect(x.shape, y.shape)) as double) / (16 - len(list_intersect(x.shape, y.shape))) as overlap
    from both_ join shapes x on a = x.id join shapes y on b = y.id where cast(len(list_intersect(x.shape, y.shape)) as double) / (16 - len(list_intersect(x.shape, y.shape))) >= 0.3)"""
VIEWED = f"defs as (select * from entities where type in ({quoted(K.VIEW_TYPES)}) and length(name) >= 2)"
EDGES = f"""{VIEWED}, firsts as (select name, min(file) as first from defs group by name),
  single as (select d.name, first as file from defs d join firsts f on d.name = f.name group by d.name, first having count(*) filter (where d.file <> first) < 2),
  edges as (select r.file as src, s.file as dst, count(*) as weight from relations r join single s on r.to_name = s.name
    where r.relation in ('calls','uses','imports','instantiates','inherits') and r.file <> s.file group by 1, 2)"""


def module(path: str, depth: int) -> str:
    parts = f"string_split({path}, '/')"
    return f"case when len({parts}) > 1 then array_to_string({parts}[1:least({depth}, len({parts}) - 1)], '/') else '<root>' end"


def subgraph(cap: int = 20, hub: int = 10) -> str:
    both = "both_ as (select from_name as node, to_name as next, file, from_name, relation, to_name from relations union all select to_name, from_name, file, from_name, relation, to_name from relations where from_name <> to_name)"
    ranked = "select *, row_number() over (partition by node order by file, from_name, relation, to_name) as r, count(*) over (partition by node) as n from both_ where node in (select node from {open})"
    return f"""{KG}, {FANOUT}, {both}, f0 as (select '{Q.START}' as node), k0 as ({ranked.format(open='f0')}),
      f1 as (select distinct next as node from k0 where r <= {cap} and next <> '{Q.START}'),
      hubs as (select node from f1 join fanout on name = node where files >= {hub}), o1 as (select node from f1 where node not in (select node from hubs)),
      k1 as ({ranked.format(open='o1')})"""


LINK_PARTS = f"""ranked as materialized (select e.file, e.name, max(type) as type from entities e where type in ({quoted(K.MAP_TYPES)})
        and exists (select 1 from relations r where relation = 'defines' and r.from_name = r.file and r.file = e.file and r.to_name = e.name) group by 1, 2),
      refs as (select r.file, from_name, to_name, count(*) as weight from relations r join fanout on name = to_name and files < {rank.HUB} where relation <> 'defines' group by 1, 2, 3),
      picked as (select refs.*, d.file as def_file, row_number() over (partition by refs.file, from_name, to_name order by d.file = refs.file desc, d.file) as r
        from refs join ranked o on o.file = refs.file and o.name = from_name join ranked d on d.name = to_name),
      links as materialized (select file || chr(10) || from_name as src, def_file || chr(10) || to_name as dst, weight from picked where r = 1 and file || chr(10) || from_name <> def_file || chr(10) || to_name)"""
LINKS = f"{KG}, {FANOUT}, {LINK_PARTS}"


def pagerank(tolerance: float) -> str:
    """Rounds until the scores move by less than ``tolerance`` a node, as the operator does by default."""
    a = rank.ALPHA
    out = f"""{KG.replace("with ", "with recursive ", 1)}, {FANOUT}, {LINK_PARTS},
      outs as materialized (select src, sum(weight) as total from links group by src),
      base0 as (select file || chr(10) || name as node, 1.0 + case when contains(file, 'svc/') then 10.0 else 0.0 end + case when name = '{Q.NAME}' then 50.0 else 0.0 end as p from ranked),
      base as materialized (select node, cast(p as double) / (select sum(p) from base0) as p, total is null as dangling from base0 left join outs on src = node),
      walk(i, node, p, dangling, score, gap) as (
        select 0, node, p, dangling, 1.0::double / (select count(*) from base), 1e9::double from base
        union all (with now as (select * from walk where gap >= {tolerance} * (select count(*) from base)),
          moved as (select dst as node, sum(score * weight / total) as "in" from links join outs using (src) join now on now.node = src group by dst),
          new as (select i + 1 as i, node, p, dangling, {a} * (coalesce("in", 0) + (select coalesce(sum(score), 0) from now where dangling) * p) + {1 - a} * p as score, score as was
            from now left join moved using (node))
          select i, node, p, dangling, score, sum(abs(score - was)) over () from new))
      select node, round(score * 1e6, 3) as score from walk where i = (select max(i) from walk)"""
    return out


def like_literals(column: str, literals: list[str]) -> str:
    return " or ".join(f"contains(lower({column}), '{x.lower()}')" for x in literals) or "false"


def windows(size: int, stride: int, least: int = 60, whole: int = 10) -> str:
    trimmed = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    return f"""with files as ({FILES}), ls as (select file, string_split(text, chr(10)) as l, text from files where text is not null),
      cut as (select file, text, i + 1 as line_start, regexp_replace(array_to_string(l[i + 1:i + {size}], chr(10)), '\\s+$', '') as piece from (select file, text, l, unnest(range(0, len(l), {stride})) as i from ls)),
      good as (select file, line_start, piece from cut where length({trimmed.format('piece')}) >= {least})
      select file, line_start, md5(piece) as digest from good
      union all select file, 1, md5(text) from files where file not in (select file from good) and length({trimmed.format('text')}) >= {whole}"""


HTML = "with p as (select 'p' || cast(page_id as varchar) || '.html' as file, html as text from pages)"
LITERALS = X.query_literals(Q.LITERAL_QUERY)
HYBRID_TEXT = Q.TEXT_QUERY + " re-eaux"
PLACED_ONLY = """placed as (select vec_id, 'v/f' || cast(vec_id % 50 as varchar) || '.py' as file, 'E' || cast(vec_id % 97 as varchar) as name, case label % 3 when 0 then 'class' when 1 then 'function' else 'variable' end as type,
  case when vec_id % 2 = 0 then 'Extracted from a file' else 'Referenced' end as description, case when vec_id % 5 <> 0 then cast(vec_id as bigint) end as line_start from embeddings)"""
PLACED = "with " + PLACED_ONLY
NAMED = f"near as (select 'Customer' || cast(e.vec_id as varchar) as name, {DOT.format(a='e.embedding', b='q.embedding')} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q order by 2 desc, 1 limit 10)"
SNIPPETS = """with s as (select p_partkey, p_partkey % 8 as k, p_partkey % 9 as e, p_partkey % 2 = 0 as fn from part),
 l as (select *, case e when 0 then 'python' when 1 then 'ts' when 2 then 'ts' when 3 then 'rust' when 4 then 'go' when 5 then 'java' when 6 then 'go' when 7 then 'c' else '' end as lang from s),
 t as (select p_partkey, list_filter([
   case when (lang = 'python' and k = 0) or (lang = 'rust' and k = 3) then 'async' end,
   case when (lang in ('python', 'ts') and k = 0) then 'generator' end,
   case when (lang = 'ts' and k = 1) or (lang = 'rust' and k = 3) or (lang = 'java' and k = 6) or lang in ('go', 'python') then 'exported' end,
   case when lang = 'ts' and k = 1 then 'default-export' end, case when lang = 'ts' and k = 2 then 'input' end, case when lang = 'ts' and k = 2 then 'signal' end,
   case when lang <> '' and k = 4 then 'deprecated' end, case when lang in ('java', 'c', 'ts') and k = 5 then 'static' end,
   case when (lang in ('ts', 'java') and k = 6) then 'abstract' end, case when e = 6 then 'test' end], lambda x: x is not null) as ts from l)"""

SOURCES = """with s as (select doc_id as n, length(trim(text)) < 50 as quiet from documents), one as (select * from s where n % 3 <> 0)"""
WRITTEN = f"""{KG}, b as (select file, count(*) as n_entities, count(*) filter (where type <> 'module') as made, file not like '%7.ts' as there from entities group by file),
  q as (select file, from_name || '_2' as from_name, relation, to_name from relations where relation <> 'defines'),
  names as (select file, name || '_2' as name from entities where type <> 'module' union all select file, file from b),
  ok as (select distinct q.* from q join names n on n.file = q.file and (n.name = from_name or n.name = to_name)),
  k as (select file, count(*) as kept from ok where not (relation = 'uses' and exists (select 1 from ok o where o.relation = 'calls' and o.file = ok.file and o.from_name = ok.from_name and o.to_name = ok.to_name)) group by file),
  o as (select file, count(*) as offered from q group by file), h as (select file, count(*) as had from relations group by file),
  report as (select b.*, coalesce(kept, 0) as kept, coalesce(offered, 0) as offered, had, case when not there then 'missing' when coalesce(offered, 0) = 0 then 'rejected' else 'replaced' end as status
    from b left join k using (file) left join o using (file) left join h using (file))"""

ORACLES: dict[str, str] = {
    "chunk_windows": windows(8, 6),
    "chunk_fixed": f"with files as ({FILES}) select file, i + 1 as line_start, md5(array_to_string(l[i + 1:i + 5], chr(10))) as digest from (select file, l, unnest(range(0, len(l), 5)) as i from (select file, string_split(text, chr(10)) as l from files)) where regexp_matches(array_to_string(l[i + 1:i + 5], chr(10)), '\\S')",
    "tokenize_terms": f"with {POSTED} select term, count(*) as df, cast(sum(tf) as bigint) as tf from posted group by term",
    "bm25_topk": f"with {bm25(Q.TEXT_QUERY)} select chunk_id, round(bm25, 5) as bm25 from bm order by bm25.bm25 desc, chunk_id limit 20".replace("bm25.bm25", "bm.bm25"),
    "literal_idf": "with x(literal) as (values " + ", ".join(f"('{x}')" for x in LITERALS) + ") select literal, (select count(*) from documents where contains(lower(text), lower(literal))) as df, round(ln((select count(*) from documents) / cast(greatest((select count(*) from documents where contains(lower(text), lower(literal))), 1) as double)), 6) as idf from x",
    "dense_topk": f"with {DENSE} select chunk_id, round(dense, 6) as score from dense order by dense desc, chunk_id limit 20",
    "hybrid_search": f"""with {bm25(HYBRID_TEXT)}, {DENSE}, near as (select * from dense where chunk_id in (select chunk_id from chunks) order by dense desc, chunk_id limit 30),
      head as (select chunk_id from chunks left join bm using (chunk_id) order by coalesce(bm25, 0) desc, chunk_id limit 30),
      ids as (select chunk_id from head union select chunk_id from near union select chunk_id from chunks where {like_literals('text', X.query_literals(HYBRID_TEXT))})
      select chunk_id, file, round(0.5 * coalesce(bm25, 0) / (select max(bm25) from bm) + 0.5 * coalesce(dense, 0), 5) as score
      from ids join chunks using (chunk_id) left join bm using (chunk_id) left join near using (chunk_id) order by 0.5 * coalesce(bm25, 0) / (select max(bm25) from bm) + 0.5 * coalesce(dense, 0) desc, chunk_id limit 10""",
    "knn_per_entity": f"with {PAIRS} select query, neighbour, round(score, 6) as score from (select *, row_number() over (partition by query order by score desc, neighbour) as r from pairs) where r <= 3",
    "find_similar": f"""with names as (select vec_id, 'E' || cast(vec_id % 97 as varchar) as name, case label % 3 when 0 then 'class' when 1 then 'function' else 'variable' end as type from embeddings),
      near as (select e.vec_id, {DOT.format(a='e.embedding', b='q.embedding')} as score from embeddings e, (select embedding from embeddings where vec_id = 5) q order by 2 desc, 1 limit 80),
      best as (select vec_id, name, type, score, row_number() over (partition by name order by score desc, vec_id) as r from near join names using (vec_id) where score >= 0.1 and name <> 'E5' and type in ('class', 'function'))
      select vec_id, name, type, round(score, 6) as score from best where r = 1 order by best.score desc, vec_id limit 10""",
    "dead_code_verified": f"""with l as (select unnest(string_split(text, chr(10))) as line from documents), c as (select line, regexp_replace(line, '^\\s+', '') as start from l),
      p as (select line, {' || '.join(f"regexp_extract_all(line, '{x}', 1)" for x in analytics.DECLARED)} as declared from c where not ({' or '.join("starts_with(start, '" + m.replace("'", "''") + "')" for m in K.COMMENT_MARKS)})),
      used as (select distinct unnest(list_filter(regexp_extract_all(line, '[\\w$]+'), lambda x: not list_contains(declared, x))) as name from p),
      names as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) as name from documents)
      select name from names where name not in (select name from used) and name not in ({quoted(K.FRAMEWORK_METHODS)})""",
    "extractor_payload": f"with files as ({FILES}) select file, nullif(regexp_extract(text, '\\S+'), '') as name, cast(regexp_matches(text, '\\S') as int) as n_relations from files",
    "memory_listing": """with t as (select *, row_number() over (partition by role order by conv_id desc, turn desc) as r from conversations)
      select role, count(*) as n, max(conv_id) as newest, string_agg(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 80), chr(10) order by r) filter (where r <= 5) as listing from t group by role""",
    "search_report": f"""with {bm25(Q.TEXT_QUERY)}, best as (select chunk_id, bm25 as score from bm order by bm.bm25 desc, chunk_id limit 8)
      select chunk_id, file || ' lines=1-' || len(string_split(text, chr(10))) || ' score=' || printf('%.4f', score) || chr(10) || substr(text, 1, 300) as block from best join chunks using (chunk_id)""",
    "sanitize_entities": f"""{KG}, raw as (select file, case when line_start % 7 = 0 then name || '.py' else name end as name, line_start % 5 as k, type, traits from entities)
      select file, name, case k when 0 then 'class' when 1 then 'symbol' else type end as type,
      array_to_string(list_filter(list_concat(string_split(traits, ' '), [case when k = 1 then 'gizmo' else '' end]), lambda x: x <> ''), ',') as tags from raw where name not like '%.py' or name = file""",
    "structural_search": f"{HTML}, l as (select file, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from p) select file, n as line, unnest(regexp_extract_all(line, 'track\\([^,()]+?\\)')) as match from l",
    "embed_documents": f"""with {CHUNKS}, {TOKENIZED} select chunk_id as doc_id, substr(sha256('m' || chr(10) || text), 1, 32) as hash, case when len(ts) > 0 then 1.0 else 0.0 end as norm from tokens join documents on doc_id = chunk_id""",
    "embedding_cache": "select substr(sha256('hashed-64' || chr(10) || text), 1, 32) as hash, count(*) as n, min(doc_id) as first from documents group by 1",
    "find_usages": f"{KG} {USAGES}",
    "get_callers": f"{KG} select file, from_name as caller from ({USAGES}) where relation = 'calls'",
    "file_deps": f"{KG} select relation, from_name, to_name from relations where file = '{Q.FILE}' and relation in ('imports', 'inherits', 'uses')",
    "file_entities": f"{KG} select name, type, description, line_start from entities where file = '{Q.FILE}'",
    "find_similar_named": f"""{PLACED}, ranked as (select vec_id, file, name, type, row_number() over (partition by name order by type not in ({quoted(K.CLONE_TYPES)}), not starts_with(description, 'Extracted from'), line_start is null, file, line_start nulls first, vec_id) as r from placed),
      near as (select e.vec_id, {DOT.format(a='e.embedding', b='q.embedding')} as score from embeddings e, (select embedding from embeddings join ranked using (vec_id) where name = 'E5' and r = 1) q order by 2 desc, 1 limit 80),
      names as (select name, max(score) as score from near join placed using (vec_id) where score >= 0.1 and name <> 'E5' group by name)
      select file, name, type, round(score, 6) as score from ranked join names using (name) where r = 1 and type in ({quoted(K.CLONE_TYPES)}) order by names.score desc, name limit 10""",
    "explain_file": f"""{KG}, d as (select distinct name from entities where file = '{Q.FILE}' and type in ({quoted(K.EXPLAIN_TYPES)})),
      t as (select *, row_number() over (partition by key order by file, from_name, relation, to_name) as r from (select file, from_name, relation, to_name, unnest(list_distinct([to_name, {LEAF}])) as key from relations where file <> '{Q.FILE}') where key in (select name from d))
      select key as name, count(*) as total, string_agg(file || ':' || from_name, ',' order by r) filter (where r <= 5) as callers from t group by key""",
    "affected_files": f"""{KG}, n as (select distinct name from entities where file = 'svc/supply/n7.ts')
      select distinct file from (select file from relations where relation in ({quoted(K.REFERENCES)}) and to_name in (select name from n)
      union all select file from relations where relation in ({quoted(['imports', *K.REFERENCES])}) and contains(to_name, '.') and {LEAF} in (select name from n)
      union all select file from relations where relation = 'imports' and to_name in ('svc/supply/n7.ts', 'svc/supply/n7', './svc/supply/n7', './n7', 'svc.supply.n7', 'supply.n7', 'n7')
      union all select 'svc/supply/n7.ts')""",
    "graph_stats": f"{KG} select 'entities' as metric, count(*) as n from entities union all select 'relations', count(*) from relations union all select 'type:' || type, count(*) from entities group by type union all select 'relation:' || relation, count(*) from relations group by relation "
    f"union all select 'files', count(*) from ({META}) m union all select 'embedding_cache', count(distinct text) from documents",
    "list_entities": f"{KG} select file, name, type from entities where type = 'function' order by file, line_start nulls last, name limit 25",
    "find_entity_by_name": f"""{KG}, {NAMED}, found as (select *, cast(contains(lower(name), 'customer') as int) as hits from entities where contains(lower(name), 'customer')
      order by hits desc, case when lower(name) = 'customer 7' then 0 when starts_with(lower(name), 'customer 7') then 1 else 2 end, name, file, type limit 30)
      select file, name, type, description, line_start, 'name' as found from found order by name not in (select name from near where score > 0.3), name, file, type limit 10""",
    "find_entity_by_meaning": f"""{KG}, {NAMED}, close_ as (select * from near where score > 0.1), found as (select e.file, e.name, e.type, e.description, e.line_start, count(*) as hits from entities e join close_ c on contains(lower(e.name), lower(c.name)) group by all
      order by hits desc, e.name, e.file, e.type limit 30) select file, name, type, description, line_start, 'vector' as found from found order by name not in (select name from close_), name, file, type limit 10""",
    "find_entity_in_texts": f"""with files as ({FILES}) select file, '{Q.ABSENT}' as name, 'symbol' as type, 'Raw text match, no entity of the graph' as description, line as line_start, 'text' as found
      from (select file, generate_subscripts(ls, 1) as line, unnest(ls) as t from (select file, string_split(text, chr(10)) as ls from files)) where contains(lower(t), '{Q.ABSENT}') order by file, line limit 10""",
    "search_entity_tokens": f"""{KG} select file, name, type, hits from (select *, cast(contains(lower(name), 'red_bolt') as bigint) + cast(contains(lower(name), 'red') as bigint) + cast(contains(lower(name), 'bolt') as bigint) as hits from entities)
      where hits >= 1 order by hits desc, case when lower(name) = 'red_bolt' then 0 when starts_with(lower(name), 'red_bolt') then 1 else 2 end, name, file, type limit 15""",
    "pending_files": f"""with disk as ({DISK}), meta as ({META}) select file, status from (select file, case when d.mtime is null then 'missing' when m.mtime is null then 'unindexed' when d.mtime <> m.mtime then 'stale' when not incoming_done then 'needs_incoming' end as status
      from disk d full join meta m using (file)) where status is not null""",
    "build_status": f"""with disk as ({DISK}), meta as ({META}), j as (select d.mtime as dm, m.mtime as mm from disk d full join meta m using (file))
      select *, deleted > 0 or stale > 0 or indexed_project < total as needs_build from (select count(dm) as total, count(mm) as indexed, count(*) filter (where dm is not null and mm is not null) as indexed_project,
      count(*) filter (where dm is null) as deleted, count(*) filter (where dm <> mm) as stale from j)""",
    "schema_listing": "select * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in [("entity_type", t, t) for t in K.ENTITY_TYPES] + [("alias", a, t) for a, t in K.TYPE_ALIASES.items()] + [("relation_type", r, r) for r in K.RELATION_TYPES]) + ") t(kind, name, value)",
    "filter_by_trait_all": f"{KG} select file, name, type, traits, line_start from entities where contains(' ' || traits || ' ', ' async ') and contains(' ' || traits || ' ', ' test ') order by file, line_start nulls first, name limit 50",
    "filter_by_trait_any": f"{KG} select file, name, type, traits, line_start from entities where (contains(' ' || traits || ' ', ' exported ') or contains(' ' || traits || ' ', ' test ')) and contains(file, 'supply') and type in ('class', 'function') order by file, line_start nulls first, name limit 50",
    "resolve_candidates": f"""{KG}, f as (select distinct file, regexp_replace(file, '\\.[^./]+$', '') as bare from entities), p as (select *, string_split(bare, '/') as parts from f)
      select file, unnest(list_distinct(list_filter([file, bare, './' || bare, './' || parts[-1], array_to_string(parts, '.'), case when starts_with(bare, 'src/') then array_to_string(parts[2:], '.') end,
      case when len(parts) > 2 then array_to_string(parts[2:], '.') end, case when len(parts) > 2 then array_to_string(parts[3:], '.') end], lambda x: x is not null and x <> ''))) as candidate from p""",
    "file_kinds": """with e(i, e, kind, indexable) as (values (1, 'x.py', 'module', true), (2, '.env', 'config', true), (3, 'style.scss', 'style', true), (4, 'a.html', 'template', true), (5, 'conf.yaml', 'config', true), (6, 'README.md', 'doc', true),
      (7, 'id_rsa', 'module', false), (8, 'test_x.py', 'module', true), (9, 'x.spec.ts', 'module', true), (10, 'Makefile', 'module', true)),
      n as (select case n_nationkey % 3 when 0 then 'build/' when 1 then 'src/tests/' else 'src/latest/' end as head, lower(n_name) as name from nation)
      select head || name || '/' || e as file, kind, case head when 'build/' then 'build/' || name else head[1:length(head) - 1] end as module, i in (2, 7) as secret, head = 'build/' as ignored, head <> 'build/' or i in (8, 9) as test, indexable from n, e""",
    "subgraph_edges": f"{subgraph()} select distinct from_name, relation, to_name from (select * from k0 where r <= 20 union all select * from k1 where r <= 20)",
    "subgraph_nodes": f"""{subgraph()} select '{Q.START}' as name, cast(0 as bigint) as hop, case when (select max(n) from k0) > 20 then 'truncated' else 'expanded' end as state
      union all select node, 1, 'hub' from hubs union all select o1.node, 1, case when coalesce(max(n), 0) > 20 then 'truncated' else 'expanded' end from o1 left join k1 on o1.node = k1.node group by o1.node""",
    "hub_names": f"{KG}, {FANOUT} select name, files from fanout where files >= 10",
    "pagerank": pagerank(1e-6),
    "dead_code": f"""{KG} select file, name, type, line_start from entities e where type in ({quoted(K.DEAD_TYPES)}) and name not in (select to_name from relations where relation in ({quoted(K.REFERENCES)}))
      and not (description ilike 'Template %') and not (description ilike 'JSX component reference%') and name not in ({quoted(K.FRAMEWORK_METHODS)})
      and file not like 'app/crm/machinery/%' and file not like 'tests/%'""",
    "test_coverage_summary": f"{KG}, {COVER} select type, n, n_covered, round(100.0 * n_covered / n, 1) as pct from (select type, count(*) as n, count(*) filter (where covered) as n_covered from production group by type)",
    "test_coverage_uncovered": f"{KG}, {COVER} select file, name, type from production where not covered order by file, name, type limit 50",
    "test_coverage_entity": f"{KG}, {COVER} select distinct file, from_name from keys where name = 'Customer7'",
    "clone_pairs": f"with {CLONES} select a, b, round(score, 5) as score, round(overlap, 5) as overlap from clones",
    "find_clones": f"""with recursive {PLACED_ONLY}, {CLONES.replace('r <= 20', 'r <= 19').replace('clones as (', 'untyped as (', 1)}, clones as (select u.* from untyped u join placed x on a = x.vec_id join placed y on b = y.vec_id where x.type <> 'variable' and y.type <> 'variable'),
      e as (select a, b from clones union select b, a from clones), walk(id, root) as (select distinct a, a from e union select e.b, root from walk join e on e.a = id), c as (select id, min(root) as component from walk group by id),
      s as (select component, round(avg(score), 4) as s, round(avg(overlap), 4) as o, count(*) as n from clones join c on a = id group by component),
      m as (select component, string_agg(concat_ws(':', file, cast(coalesce(line_start, 0) as varchar), name, type), ',' order by file, coalesce(line_start, 0), name, type) as members from c join placed on id = vec_id group by component)
      select round(s, 3) as avg_score, round(o, 3) as avg_overlap, n as n_pairs, members from s join m using (component) order by s.s desc, s.o desc, component limit 50""",
    "clone_clusters": f"""with recursive {CLONES}, e as (select a, b from clones union select b, a from clones), walk(id, root) as (select distinct a, a from e union select e.b, root from walk join e on e.a = id),
      c as (select id, min(root) as component from walk group by id), s as (select component, avg(score) as s, avg(overlap) as o, count(*) as n from clones join c on a = id group by component)
      select c.component, string_agg(cast(id as varchar), ',' order by id) as members, round(round(any_value(s), 4), 3) as avg_score, round(round(any_value(o), 4), 3) as avg_overlap, any_value(n) as n_pairs from c join s on c.component = s.component group by c.component""",
    "exact_clones": "select md5(text) as digest, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1",
    "file_edges": f"{KG}, {EDGES} select src, dst, weight from edges",
    "module_edges": f"{KG}, {EDGES} select * from (select {module('src', 2)} as src, {module('dst', 2)} as dst, cast(sum(weight) as bigint) as weight from edges group by 1, 2) where src <> dst",
    "file_entity_summary": f"""{KG}, s as (select file, name, row_number() over (partition by file order by coalesce(line_start, 0), name, type) as r from entities where type in ({quoted(K.VIEW_TYPES)}) and length(name) > 1 and name <> file and not (type = 'module' and contains(name, '/')))
      select e.file, e.total, coalesce(n.names, '') as names from (select file, count(*) as total from entities group by file) e left join (select file, string_agg(name, ',' order by r) as names from s where r <= 5 group by file) n on e.file = n.file""",
    "connected_files": f"""{KG}, {EDGES}, c as (select file, cast(sum(weight) as bigint) as conn from (select src as file, weight from edges union all select dst, weight from edges) group by file),
      m as (select {module('file', 2)} as module, file, conn from c) select * from (select module, file, conn, row_number() over (partition by module order by conn desc, file) as rank from m) where rank <= 5""",
    "template_tags": f"{HTML} select file, name, case when regexp_matches(name, '[-:]') then 'component' else 'template' end as type, case when regexp_matches(name, '[-:]') then 'uses' else 'defines' end as relation, count(*) as n from (select file, unnest(regexp_extract_all(text, '<([A-Za-z][A-Za-z0-9:_-]*)', 1)) as name from p) group by all",
    "template_selectors": f"""{HTML}, c as (select file, unnest(regexp_split_to_array(trim(x), '\\s+')) as c from (select file, unnest(regexp_extract_all(text, 'class(?:Name)?\\s*=\\s*["'']([^"'']+)["'']', 1)) as x from p))
      select distinct file, '.' || c as name from c where c <> '' union select distinct file, '#' || unnest(regexp_extract_all(text, 'id\\s*=\\s*["'']([^"'']+)["'']', 1)) from p""",
    "template_references": "select n_name || '.html' as file, r as relation, case x when '*' then lower(n_name) when 'item' then 'item' || cast(n_nationkey as varchar) else x end as name from nation, (values ('calls', 'save'), ('calls', 'count'), ('calls', '*'), ('uses', 'item'), ('uses', 'ready'), ('uses', 'user')) t(r, x)",
    "stylesheet_selectors": """select n_name || '.css' as file, name, type, relation from (
      select n_name, unnest([{'name': '--w-' || cast(n_regionkey as varchar), 'type': 'variable', 'relation': 'defines'}, {'name': 'base.css', 'type': 'import', 'relation': 'imports'},
      {'name': '.n' || cast(n_nationkey as varchar), 'type': 'selector', 'relation': 'defines'}], recursive := true) from nation)""",
    "config_keys": "select name, count(*) as n from (select unnest(json_keys(props)) as name from events) group by name",
    "config_lines": f"with files as (select doc_id as file, regexp_replace(text, '(?m)^([A-Za-z]{{4}})[a-z]* ', '\\1: ', 'g') as text from documents), k as (select distinct file, regexp_extract(l, '^[ \\t]*[\"'']?([A-Za-z0-9_.-]+)[\"'']?\\s*[:=]', 1) as name from (select file, unnest(string_split(text, chr(10))) as l from files)) select name, count(*) as n from k where name <> '' group by name",
    "snippet_locator": f"""with files as ({FILES}), l as (select file, string_split(text, chr(10)) as l from files), n(name, leaf) as (values ('der', 'der'), ('pkg.the', 'the'), ('zzzz', 'zzzz')),
      c as (select file, name, len(l) as lines, list_filter([list_position(list_transform(l, lambda x: contains(x, p)), true) for p in ['def ' || name, 'class ' || name, 'function ' || name, 'const ' || name, 'let ' || name, 'var ' || name, 'def ' || leaf, 'class ' || leaf, 'function ' || leaf, 'const ' || leaf, 'let ' || leaf, 'var ' || leaf, case when leaf <> name then leaf || '(' end, name, leaf] if p is not null], lambda i: i > 0)[1] as pos from l, n)
      select file, name, cast(pos as bigint) as line_start, cast(case when pos is not null then least(lines, pos + 2) end as bigint) as line_end from c""",
    "traits_detect": SNIPPETS + " select p_partkey, array_to_string(list_sort(ts), ' ') as traits from t",
    "backfill_traits": SNIPPETS + " select array_to_string(list_sort(ts), ' ') as traits, count(*) as n from t where len(ts) > 0 group by 1",
    "tag_sanitizer": """with t as (select p_partkey, list_filter(regexp_split_to_array(p_name || ', ' || p_brand || ', ' || p_type || ', A B C', '[,\\s]+'), lambda t: t <> '')[1:8] as l from part),
      u as (select p_partkey, generate_subscripts(l, 1) as i, substr(regexp_replace(regexp_replace(lower(unnest(l)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) as x from t),
      f as (select p_partkey, x, min(i) as i from u where x <> '' group by 1, 2) select p_partkey, string_agg(x, ',' order by i) as tags from f group by p_partkey""",
    "entity_types": f"select coalesce(case when lower(event_type) in ({quoted(K.ENTITY_TYPES)}) then lower(event_type) end, (select value from (values " + ", ".join(f"('{a}', '{t}')" for a, t in K.TYPE_ALIASES.items()) + ") al(a, value) where a = lower(event_type)), 'symbol') as type, event_type, count(*) as n from events group by event_type",
    "sanitize_relations": f"""{KG}, k as (select file, name from entities where type <> 'function' union select file, file from relations), r as (select * from relations where not (relation = 'defines' and to_name <> file and regexp_matches(lower(to_name), '\\.(py|ts)$'))),
      v as (select distinct r.* from r where exists (select 1 from k where k.file = r.file and k.name = from_name) or exists (select 1 from k where k.file = r.file and k.name = to_name)),
      w as (select * from v where not (relation = 'uses' and exists (select 1 from v c where c.relation = 'calls' and c.file = v.file and c.from_name = v.from_name and c.to_name = v.to_name)))
      select relation, count(*) as n, count(distinct to_name) as names from w group by relation""",
    "dedupe_calls_uses": f"{KG} select file, relation, count(*) as n from relations r where not (relation = 'uses' and exists (select 1 from relations c where c.relation = 'calls' and c.file = r.file and c.from_name = r.from_name and c.to_name = r.to_name)) group by file, relation",
    "entity_texts": f"""{KG}, t as (select file, from_name, relation, to_name, row_number() over (partition by file, from_name, relation order by to_name) as r from relations),
      parts as (select file, from_name, list_position([{quoted(K.DIGEST_ORDER)}], relation) as spot, relation || ' ' || string_agg(to_name, ', ' order by to_name) as part from t where r <= 6 group by file, from_name, relation),
      digest as (select file, from_name as name, string_agg(part, '; ' order by spot) as digest from parts group by 1, 2)
      select file, name, type, md5(concat_ws(chr(10), name, digest, nullif(trim(coalesce(description, '')), ''))) as digest from entities left join digest using (file, name)""",
    "build_graph": f"""{SOURCES} select (select count(*) from one) as indexed, 0 as deleted, (select count(*) from one where not quiet and n % 11 = 0) as remaining,
      (select count(*) from one where quiet or n % 11 <> 0) as total_files, (select 2 * count(*) from one where not quiet and n % 11 <> 0) as entities, (select 3 * count(*) from one where not quiet and n % 11 <> 0) as relations""",
    "build_incremental": f"""{SOURCES}, two as (select * from s where n % 5 <> 0) select (select count(*) from two where n % 3 = 0 or n % 4 = 0 or (not quiet and n % 11 = 0)) as indexed,
      (select count(*) from one where n % 5 = 0 and (quiet or n % 11 <> 0)) as deleted, (select count(*) from two where not quiet and n % 11 = 0) as remaining,
      (select count(*) from two where quiet or n % 11 <> 0) as total_files, (select 2 * count(*) from two where not quiet and n % 11 <> 0) as entities, (select 3 * count(*) from two where not quiet and n % 11 <> 0) as relations""",
    "write_batch_report": f"{WRITTEN} select file, status, cast(case when status = 'replaced' then offered - kept else 0 end as bigint) as relations_dropped, status = 'replaced' as needs_incoming from report",
    "write_batch_graph": f"""{WRITTEN} select file, case when status = 'replaced' then 2 else 1 end as mtime, status <> 'replaced' as incoming_done,
      case when status = 'replaced' then made + 1 else n_entities end as n_entities, case when status = 'replaced' then kept + made + 1 else had end as n_relations from report where status <> 'missing'""",
    "add_entity": """select 'src/u1.py' as file, name, type, description, cast(null as bigint) as line_start, traits, 77 as mtime, true as incoming_done, 2 as n_relations
      from (values ('Extra', 'class', 'added', 'exported fresh x y'), ('src/u1.py', 'module', 'Source file', '')) v(name, type, description, traits)""",
    "mark_files_seen": f"with m as ({META}), k as ({DISK}) select file, mtime, true as incoming_done from k union all select file, mtime, incoming_done from m where file not in (select file from k)",
    "cache_hit_rate": "with c as (select distinct text from documents where doc_id % 3 = 0) select count(*) as total, count(c.text) as hits, round(count(c.text) / count(*), 4) as rate from documents d left join c on d.text = c.text",
    "trait_union": SNIPPETS + " select p_partkey, array_to_string(list_sort(list_distinct(list_concat(ts, ['async', 'mine']))), ' ') as traits from t",
    "in_degree_rank": f"""{LINKS} select node, coalesce(score, 0.0) as score from (select file || chr(10) || name as node from ranked) left join (select dst as node, cast(sum(weight) as double) as score from links group by dst) using (node)""",
    "upsert_entities": f"""{KG}, n as (select file, name, type, case when line_start % 4 = 0 then '' else 'new' end as d, case when line_start % 8 <> 0 then line_start + 1 end as l, 'fresh' as t from entities where line_start % 2 = 0
      union all select file, name || '_b', type, description, line_start, traits from entities where line_start % 3 = 0)
      select file, name, type, coalesce(nullif(d, ''), description, '') as description, coalesce(l, line_start) as line_start, case when t is not null then t else traits end as traits from entities full join n using (file, name, type)""",
    "add_relations": f"{KG}, c as (select * from relations where relation = 'calls') select added, count(*) as n from (select false as added from c where to_name like '%3' union all select true from c where to_name like '%4') group by added",
    "cleanup_deleted": f"with disk as ({DISK}), meta as ({META}) select * from meta where file in (select file from disk)",
    "delete_file_data": f"{KG} select file, count(*) as n from entities where file not in (select file from entities where type = 'function') group by file",
    "write_batch_status": f"""{KG}, b as (select file, count(*) as n from entities group by file), r as (select file, count(*) as n from relations where relation <> 'defines' group by file)
      select b.file, case when b.file like '%7.ts' then 'missing' when r.n is null then 'rejected' else 'replaced' end as status from b left join r on b.file = r.file""",
    "regex_search": f"""with files as ({FILES}), l as (select file, generate_subscripts(ls, 1) as line, unnest(ls) as t from (select file, string_split(text, chr(10)) as ls from files))
      select file, line, unnest(regexp_extract_all(t, '{Q.PATTERN}')) as match from l""",
    "raw_occurrences": f"""with files as ({FILES}), l as (select file, ls, generate_subscripts(ls, 1) as line, unnest(ls) as t from (select file, string_split(text, chr(10)) as ls from files))
      select file, line, md5(regexp_replace(array_to_string(ls[greatest(line - 2, 1):line + 2], chr(10)), '^\\s+|\\s+$', '', 'g')) as context from l where contains(lower(t), '{Q.WORD}')""",
    "stream_latest_meta": "select user_id as file, max(event_id) as mtime, count(*) as n from events group by user_id",
    "stream_tumbling_counts": "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
}
ORACLES["mark_stale_cascade"] = (
    ORACLES["affected_files"].replace("select distinct file from (select file from relations", ", hit as (select distinct file from (select file from relations", 1)
    + ") select file, cast(case when file in (select file from hit) then 0 else length(file) end as bigint) as mtime, file in (select file from hit) as marked from (select distinct file from entities)"
)
STYLES = ORACLES["stylesheet_selectors"]
CONFIGS = "select 'e' || cast(event_id as varchar) || '.json' as file, unnest(json_keys(props)) as name from events"
ORACLES["structured_entities"] = f"""select file, name, type from ({ORACLES["template_tags"]}) a union select file, name, 'selector' from ({ORACLES["template_selectors"]}) b
  union select file, name, type from ({STYLES}) c union select file, name, 'variable' from ({CONFIGS}) d"""
ORACLES["structured_relations"] = f"""select file, relation, count(*) as n, max(name) as last from (select file, relation, name from ({STYLES}) c
  union select file, 'defines', name from ({CONFIGS}) d) group by file, relation"""
ORACLES["explain_file_full"] = f"""select 'defines' as part, name, type as kind, description as detail, line_start as n from ({ORACLES["file_entities"]}) a
  union all select 'depends', to_name, relation, from_name, null from ({ORACLES["file_deps"]}) b union all select 'used_by', name, null, callers, total from ({ORACLES["explain_file"]}) c"""
WORDS = quoted([f"{w} {n}" for n in ("pkg.the", "the") for w in "def class function const let var".split()] + ["the(", "pkg.the", "the"])
ORACLES["entity_places"] = f"""with files as ({FILES}), l as (select file, string_split(text, chr(10)) as l from files),
  c as (select file, l, list_filter([list_position(list_transform(l, lambda x: contains(x, p)), true) for p in [{WORDS}]], lambda i: i > 0)[1] as spot from l)
  select file, 'pkg.the' as name, case when file like '%.en' then 3 else spot end as line_start, cast(case when spot is not null then least(len(l), spot + 2) end as bigint) as line_end,
  md5(case when spot is not null then regexp_replace(array_to_string(l[greatest(spot - 2, 1):least(len(l), spot + 2)], chr(10)), '^\\s+|\\s+$', '', 'g') end) as snippet from c"""
ORACLES["entity_blocks"] = f"""{KG} select name, '  • [' || type || '] ' || name || ': ' || description || '  (' || file || case when line_start is null then '' when line_start % 2 = 0 then ':' || cast(line_start as varchar) || '-' || cast(line_start + 3 as varchar) else ':' || cast(line_start as varchar) end || ')'
  || case when line_start % 3 = 0 then chr(10) || '      def ' || name || chr(10) || '        pass' else '' end as block from entities where file = '{Q.FILE}'"""
LINES = f"{KG}, l as (select from_name, relation, string_agg(to_name, ', ' order by to_name) as names from relations where file = '{Q.FILE}' group by 1, 2)"
ORACLES["relation_lines"] = f"{LINES} select from_name, relation, '    ' || relation || ': ' || names as line from l"
ORACLES["relation_section"] = f"{LINES} select 'Imports:' || coalesce(chr(10) || string_agg(relation || ': ' || names, chr(10) order by from_name), '') as section from l where relation = 'imports'"
ORACLES["scored_notes"] = "select conv_id, turn, '  [' || role || '] score=' || format('{:.2f}', length(role) / 7) || ' ' || substr(text, 1, 120) as line from conversations"
