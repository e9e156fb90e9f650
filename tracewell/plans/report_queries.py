"""Queries of decoding, labelling, the knowledge base, technique roll-ups and evaluation over the standard tables, with their DuckDB SQL.

The tables stand for what the operators read: users for reports and procedures, event types for phrases and labels, parts for techniques, line items for
relationships. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import preprocessing as P
from tracewell.operators import decoding, labelling, report_graphs, techniques
from tracewell.sources import knowledge, reports

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- decoding: a user's events are alignments; every event stands at its place and the place of the one before

_ALIGNED = """
    e as (select user_id, event_id, event_type, value, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as place from events),
    a as (select user_id as report, place as location, 'T' || (event_id % 7) || case when event_id % 3 = 0 then '.00' || (event_id % 2) else '' end as tech,
        0.7 + value / 400 as value, list_distinct([place, greatest(0, place - event_id % 4)]) as order_ids, [place // 3, (place + event_id % 5) // 3] as sentences, event_id as seq from e)
"""


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "value", place.alias("place"))
    e, at = F.col("event_id"), F.col("place")
    tech = F.concat(F.lit("T"), (e % 7).cast("string"), F.when(e % 3 == 0, F.concat(F.lit(".00"), (e % 2).cast("string"))).otherwise(""))
    before = F.greatest(F.lit(0), at - (e % 4).cast("int"))
    return rows.select(
        F.col("user_id").alias("report"), at.alias("location"), tech.alias("tech"), (0.7 + F.col("value") / 400).alias("value"),
        F.array_distinct(F.array(at, before)).alias("order_ids"), F.array(F.expr("int(place div 3)"), F.expr("int((place + event_id % 5) div 3)")).alias("sentences"),
        F.array(F.struct((e % 3).cast("double").alias("rank"), at.alias("place")), F.struct(F.lit(1.0).alias("rank"), before.alias("place"))).alias("picks"), e.alias("seq"),
    )


@query(None)
def attack_path_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decoder with look-back, keyword alignments and the second, relaxed try; tests/test_decoding.py compares it with a plain walk."""
    a = _alignments(spark, sf_dir)
    keywords = a.where("seq % 11 = 0").select("report", "location", F.lit("T9").alias("tech"), F.lit(1.0).alias("value"), "order_ids", "seq")
    early = spark.createDataFrame([("T6",)], "tech string")
    found = decoding.decode_reports(a, keywords, preparation=early)
    said = lambda c: F.array_join(F.transform(c, lambda b: F.concat_ws(":", b["location"].cast("string"), b["tech"])), " ")
    return found.select("report", said("best").alias("best"), F.array_join("path", ">").alias("path"), "relaxed")


@query(f"""
    with {_ALIGNED},
    c as (select *, least(1.0, value) as v, list_aggregate(order_ids, 'min') as lo, list_aggregate(order_ids, 'avg') as mid from a
        where abs(list_aggregate(order_ids, 'min') - list_aggregate(order_ids, 'avg')) < 10 and list_aggregate(sentences, 'stddev_pop') < 2 and least(1.0, value) >= 0.87),
    n as (select *, row_number() over (partition by report order by location, v desc, seq) as turn, list_aggregate(order_ids, 'max') as spot from c),
    f as (select *, min(turn) over (partition by report, spot) as first, sum(v * spot) over (partition by report, tech) / sum(v) over (partition by report, tech) as middle from n),
    g as (select *, row_number() over (partition by report, tech order by round(abs(spot - middle), 9), -v / greatest(1.0, list_aggregate(order_ids, 'stddev_pop')), first, turn) as no,
        min([first, turn]) over (partition by report, tech) as seen from f),
    u as (select *, case when tech = 'T6' then 0 else spot end as key, row_number() over (partition by report order by spot, seen) as t from g where no = 1),
    k as (select *, row_number() over (partition by report, key order by v desc, t) as r, count(*) over (partition by report, key) as n from u),
    two as (select report, key, r, tech, mid, n from k where r <= 2),
    o as (select *, row_number() over (partition by report, key order by mid, r) as place from two),
    p as (select report, tech, min([key, place]) as spot from o group by all)
    select report, string_agg(tech, '>' order by spot) as path from p group by report
""")
def attack_path_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relaxed path of two techniques a location, preparation techniques first, by the maximum criterion and without look-back."""
    early = spark.createDataFrame([("T6",)], "tech string")
    found = decoding.decode(_alignments(spark, sf_dir), preparation=early, topk=2, criteria="max")
    return found.where(F.size("path") > 0).select("report", F.array_join("path", ">").alias("path"))


@query(f"""
    with {_ALIGNED}, t as (select distinct report, tech from a)
    select report, tech from t where tech <> 'T1' or not exists (select 1 from t o where o.report = t.report and o.tech <> 'T1')
""")
def without_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alignments(spark, sf_dir).select("report", "tech").distinct()
    return decoding.without_preparation(rows, spark.createDataFrame([("T1",)], "tech string"))


@query("""
    with p as (select p_partkey as a, p_partkey + 1 as b, 0.8 + (p_partkey % 20) / 100.0 as f1 from part), s as (select a as source, b as target, f1 from p where f1 >= 0.9 union all select b, a, f1 from p where f1 >= 0.9),
    m as (select o_custkey as report, o_orderkey % 3 as location, o_custkey % 200 + 1 as proc, 0.6 + (o_orderkey % 40) / 100.0 as score from orders),
    x as (select * from m union all select report, location, target, score * f1 from m join s on proc = source),
    r as (select report, cast(location as bigint) as location, proc, round(score, 6) as score, row_number() over (partition by report, location order by round(score, 6) desc, proc) as rank from x where round(score, 6) >= 0.8)
    select report, location, proc, score::double as score, cast(rank as integer) as rank from r where rank <= 3
""")
def similar_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the procedures that resemble theirs, the best three a location; repeated matches are rows of their own."""
    k = F.col("p_partkey")
    pairs = _read(spark, sf_dir, "part").select(k.alias("a"), (k + 1).alias("b"), F.round(0.8 + (k % 20) / 100.0, 2).alias("f1"))
    o = _read(spark, sf_dir, "orders")
    matches = o.select(F.col("o_custkey").alias("report"), (F.col("o_orderkey") % 3).alias("location"), (F.col("o_custkey") % 200 + 1).alias("proc"), F.round(0.6 + (F.col("o_orderkey") % 40) / 100.0, 2).alias("score"))
    near = decoding.similar_procedures(pairs)
    all_ = decoding.best_procedures(matches, near, -1, 0.0).withColumn("score", F.round("score", 6)).drop("rank")
    return decoding.best_procedures(all_, None, 3, 0.8)


# ---- labelling

_WORDS = [("DATA", "special", "steel"), ("DATA", "keyword", "copper"), ("FUNCTION", "special", "tin"), ("FUNCTION", "keyword", "steel"), ("USER", "keyword", "brass"), ("NETWORK", "special", "red"), ("OTHER", "keyword", "red")]
_LEXICON = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _WORDS)


@query(f"""
    with l(label, kind, term) as (values {_LEXICON}), p as (select distinct lower(coalesce(nullif(p_type, ''), p_name)) as phrase from part),
    w as (select phrase, regexp_extract(phrase, '([^ ]+)$', 1) as last from p),
    v as (select phrase, label, max(case when kind = 'special' then 2 else 0 end) + max(case when kind = 'keyword' then 1 else 0 end) as votes from w join l on last = term group by all),
    m as (select *, max(votes) over (partition by phrase) as m from v), b as (select phrase, min(label) as label, count(*) as n from m where votes = m group by phrase)
    select p.phrase, case when n = 1 then label else 'OTHER' end as label from p left join b using (phrase)
""")
def label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of part types by their last words; with terms under ten letters a ratio over 0.95 is equality. Guards, ratios and rules: tests/test_labelling.py."""
    phrase = F.lower(F.coalesce(F.when(F.col("p_type") != "", F.col("p_type")), F.col("p_name")))
    return labelling.label_phrases(_read(spark, sf_dir, "part").select(phrase.alias("phrase")).distinct(), spark.createDataFrame(_WORDS, "label string, kind string, term string"))


_GROUPS = {"look": ["view", "click"], "trade": ["purchase", "signup"], "fail": ["error"]}


@query("""
    with h as (select user_id, coalesce(list_sort(list_distinct(list(event_type) filter (h = 0))), []) as a, coalesce(list_sort(list_distinct(list(event_type) filter (h = 1))), []) as b
        from (select distinct user_id, event_type, event_id % 20 // 10 as h from events where event_id % 5 = 0) group by user_id),
    g as (select user_id, a, b, list_has_any(a, ['purchase', 'signup']) as a_t, list_has_any(b, ['purchase', 'signup']) as b_t, list_has_any(a, ['error']) as a_f, list_has_any(b, ['error']) as b_f,
        list_has_any(a, ['view', 'click']) as a_l, list_has_any(b, ['view', 'click']) as b_l from h)
    select user_id, a_t or a_f as strong, len(a) > 0 and len(b) > 0 and (a_t <> b_t or a_f <> b_f) as mismatch,
        len(a) > 0 and len(b) > 0 and (list_has_any(a, b) or (a_t and b_t) or (a_f and b_f) or (a_l and b_l)) as similar from g
""")
def verb_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong groups, mismatches and similarity of the verbs of two halves of each user's events."""
    rows = _read(spark, sf_dir, "events").where("event_id % 5 = 0").withColumn("h", F.expr("event_id % 20 div 10"))
    half = lambda k: F.array_sort(F.collect_set(F.when(F.col("h") == k, F.col("event_type"))))
    v = rows.groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b"))
    strong = ["trade", "fail"]
    return v.select("user_id", labelling.strong_verbs(F.col("a"), _GROUPS, strong).alias("strong"), labelling.strong_mismatch(F.col("a"), F.col("b"), _GROUPS, strong).alias("mismatch"),
                    labelling.similar_verbs(F.col("a"), F.col("b"), _GROUPS).alias("similar"))


# ---- text: tables that rewrite what the documents do hold

_VARIANTS = {"THAT": ["that", "This"], "UND": ["und", "mit"]}
_SQL_VARIANTS = "text"
for _k, _vs in _VARIANTS.items():
    for _v in _vs:
        _SQL_VARIANTS = f"(case when contains(lower({_SQL_VARIANTS}), '{_v.lower()}') then replace({_SQL_VARIANTS}, '{_v}', '{_k}') else {_SQL_VARIANTS} end)"


@query(f"select doc_id, md5({_SQL_VARIANTS}) as digest, {_SQL_VARIANTS} <> text as changed from documents")
def homogenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.homogenised(F.col("text"), _VARIANTS)
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(made).alias("digest"), (made != F.col("text")).alias("changed"))


@query(r"""
    with t as (select doc_id, 'For a (https://attack.mitre.org/campaigns/x), see [' || source || '](http://a/' || lang || ') and ' || replace(text, 'the ', '[the](x) ') as t from documents)
    select doc_id, md5(regexp_replace(regexp_replace(t, '^For.*?\(https://attack.mitre.org/campaigns/[^ \n\t]*\),', ''), '\[([^\]]*)\]\(([^()]|\([^()]*\))*\)', '\1', 'g')) as digest from t
""")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links put into the texts (which have none) and taken out again."""
    t = F.concat(F.lit("For a (https://attack.mitre.org/campaigns/x), see ["), F.col("source"), F.lit("](http://a/"), F.col("lang"), F.lit(") and "), F.replace("text", F.lit("the "), F.lit("[the](x) ")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(P.without_entity_links(t)).alias("digest"))


@query(r"""
    select doc_id, md5(regexp_replace(replace(text, 'that', 'before'), '\b(before|after).*?(,|\.|\n)', '', 'g')) as digest,
        md5(regexp_replace(regexp_replace(replace(regexp_replace(text, '[\n\t\r]+', ' ', 'g'), '  ', ' '), 'th[a-z]+', '', 'g'), '[0-9]+', '', 'g')) as bare from documents
""")
def clause_and_link_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(P.without_before_after(F.replace("text", F.lit("that"), F.lit("before")))).alias("digest"), F.md5(P.without_links(F.col("text"), ["th[a-z]+", "[0-9]+"])).alias("bare"))


@query("""
    with s as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i from (select doc_id, string_split(text, '. ') as l from documents)),
    r as (select doc_id, i, replace(replace(s, 'that', 'which'), 'with', 'by') as s from s),
    c as (select doc_id, i, replace(replace(replace(replace(replace(s, 'from', 'C2'), 'C2 (C2)', 'C2'), 'C2 C2', 'C2'), 'und', 'AND'), 'les', 'LES') as s from r),
    j as (select doc_id, string_agg(s, ' ' order by i) as t from c group by doc_id)
    select doc_id, md5(trim(replace(t, '  ', ' '))) as digest from j
""")
def preprocess_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default chain over the sentences of each document, put together again."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    said = docs.select("doc_id", F.posexplode(F.split("text", r"\. ", -1)).alias("sentence", "text"))
    done = P.preprocessed(docs, said, "doc_id", [("that", "which"), ("with", "by"), ("from", "C2")], [], {"AND": ["und"], "LES": ["les"]})
    return done.select("doc_id", F.md5("text").alias("digest"))


@query(r"""
    with l as (select doc_id, lang, unnest(string_split(text, chr(10))) as x from documents),
    u as (select doc_id, lang, x, trim(regexp_replace(replace(x, '- ', ''), '\n+', chr(10), 'g')) as s, list_filter(string_split(x, ' '), lambda w: trim(w) <> '') as hw from l),
    w as (select *, string_split(s, ' ') as w from u),
    q as (select *, len(list_filter(w, lambda a: regexp_matches(a, '^\p{Lu}') or not regexp_matches(a, '^[\p{L}\p{N}]+$'))) as odd, length(regexp_replace(s, '[^\p{L}]', '', 'g')) as letters,
        len(list_filter(hw, lambda a: regexp_matches(a, '^\p{Lu}'))) as caps from w)
    select doc_id, count(*) as n, cast(sum(case when regexp_matches(x, '^[0-9]{1,3}\.([0-9]{1,3}\.?)?[ \t\n\r\f]') or (len(hw) > 2 and 2 * caps >= len(hw)) or (regexp_matches(x, '\p{Lu}') and not regexp_matches(x, '\p{Ll}')) then 1 else 0 end) as bigint) as n_headers,
        cast(sum(case when s <> '' and lang = 'en' and not regexp_matches(s, '(?i)(\n|^)(Figure|Table)[ \t\n\r\f][0-9]{1,3}(.|:)[ \t\n\r\f]') and 2 * odd < len(w) and 2 * letters >= length(s) and length(s) > 64 then 1 else 0 end) as bigint) as n_prose
    from q group by doc_id
""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and prose among the lines of each document."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n", -1)).alias("x"))
    n = lambda c: F.sum(c.cast("long"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), n(P.is_header(F.col("x"))).alias("n_headers"), n(P.is_prose(F.col("x"), F.col("lang") == "en")).alias("n_prose"))


@query("""
    with w as (select doc_id, unnest(l) as w, generate_subscripts(l, 1) - 1 as i from (select doc_id, string_split(text, ' ') as l from documents where lang = 'en'))
    select doc_id, md5(string_agg(case when lower(w) in ('it', 'he', 'they') and i > 0 then 'the Fox' else w end || ' ', '' order by i)) as digest from w group by doc_id
""")
def pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pronouns of a document as one chain, whose main mention is its first word."""
    words = _read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "text")).withColumn("space", F.lit(True))
    said = words.where(F.lower("text").isin("it", "he", "they") | (F.col("i") == 0)).select("doc_id", F.lit(1).alias("chain"), "i", (F.col("i") == 0).alias("main"), F.lit("a Fox").alias("phrase"))
    return P.resolved_pronouns(words, said, ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


# ---- knowledge base: parts are techniques, line items relationships


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's objects made of parts, suppliers and line items."""
    ref = lambda name, ident, url: F.array(F.struct(name.alias("source_name"), ident.alias("external_id"), url.alias("url")))
    none = F.lit(None).cast("string")
    k = F.col("p_partkey")
    techs = _read(spark, sf_dir, "part").select(
        F.lit("attack-pattern").alias("type"), F.concat(F.lit("attack-pattern--"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), (k % 17 == 0).alias("revoked"),
        ref(F.when(k % 13 == 0, "other").otherwise("mitre-attack"), F.concat(F.lit("T"), k.cast("string")), none).alias("external_references"),
        F.transform(F.array("p_brand", (k % 3).cast("string")), lambda t: F.struct(F.lit("c").alias("kill_chain_name"), t.alias("phase_name"))).alias("kill_chain_phases"),
        F.array(F.col("p_type")).alias("x_mitre_platforms"),
    )
    subs = _read(spark, sf_dir, "part").where("p_partkey > 10").select(
        F.lit("relationship").alias("type"), F.lit("subtechnique-of").alias("relationship_type"), F.concat(F.lit("attack-pattern--"), k.cast("string")).alias("source_ref"),
        F.concat(F.lit("attack-pattern--"), (k % 10 + 1).cast("string")).alias("target_ref"),
    )
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    rels = _read(spark, sf_dir, "lineitem").select(
        F.lit("relationship").alias("type"), F.concat_ws("-", F.lit("relationship-"), F.col("l_orderkey").cast("string"), n.cast("string")).alias("id"), F.when(n % 4 == 0, "mitigates").otherwise("uses").alias("relationship_type"),
        F.concat(F.when(s % 2 == 0, "campaign--").otherwise("malware--"), s.cast("string")).alias("source_ref"),
        F.concat(F.when(n % 5 == 0, "tool--").otherwise("attack-pattern--"), F.col("l_partkey").cast("string")).alias("target_ref"), F.col("l_shipdate").cast("string").alias("description"),
        F.when(n % 3 != 0, ref(F.lit("r"), none, F.concat(F.lit("http://x/"), (s % 50).cast("string")))).alias("external_references"),
    )
    tools = _read(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 2 == 0, "malware").otherwise("tool").alias("type"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("alias"), F.col("s_name"))).alias("x_mitre_aliases")
    )
    out = techs
    for part in (subs, rels, tools):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("x_mitre_deprecated", F.lit(False))


_TECHS = "t as (select p_partkey as k, 'T' || p_partkey as tech_id, p_name as name, p_brand, p_type from part where p_partkey % 17 <> 0 and p_partkey % 13 <> 0)"


@query(f"""
    with {_TECHS}, s as (select c.tech_id, p.tech_id as parent_id from t c join t p on p.k = c.k % 10 + 1 where c.k > 10),
    n as (select parent_id as tech_id, count(*) as n from s group by all)
    select tech_id, parent_id, s.tech_id is not null as is_sub, n.n is not null as is_parent, s.parent_id is null and n.n is null as is_childless, cast(coalesce(n.n, 0) as integer) as n_children
    from t left join s using (tech_id) left join n using (tech_id)
""")
def technique_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    made = knowledge.family(knowledge.techniques(o), knowledge.parents(o))
    return made.select("tech_id", "parent_id", "is_sub", "is_parent", "is_childless", F.size("children").alias("n_children"))


_RELATIONS = "r as (select 'relationship--' || l_orderkey || '-' || l_linenumber as id, l_linenumber as n, l_suppkey as s, l_partkey as k, l_shipdate from lineitem)"


@query(f"""
    with {_TECHS}, {_RELATIONS}
    select tech_id, p_type as platform, r.id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as description from r join t using (k) where n % 4 <> 0 and n % 5 <> 0
""")
def procedure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.procedure_texts(_objects(spark, sf_dir)).select("tech_id", F.col("platforms")[0].alias("platform"), "id", "description")


@query(f"""
    with {_RELATIONS}, c as (select 'campaign' as view, id, ['http://x/' || (s % 50)] as urls from r where n % 3 <> 0 and n % 4 <> 0 and n % 5 <> 0 and s % 2 = 0),
    a as (select 'any' as view, id, case when n % 4 <> 0 and n % 5 <> 0 then ['http://x/' || (s % 50)] else [] end as urls from r where n % 3 <> 0),
    u as (select distinct 'all' as view, 'http://x/' || (s % 50) as id, [] as urls from r where n % 3 <> 0 and n % 4 <> 0)
    select view, id, cast(len(urls) as integer) as n_urls from (select * from c union all select * from a union all select * from u)
""")
def reference_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    one = lambda df, view: df.select(F.lit(view).alias("view"), "id", F.size("urls").alias("n_urls"))
    return one(knowledge.reference_urls(o, "campaign"), "campaign").union(one(knowledge.reference_urls(o), "any")).union(knowledge.all_urls(o).select(F.lit("all"), "url", F.lit(0)))


@query("""
    with a as (select 'malware' as kind, s_name as name from supplier where s_suppkey % 2 = 0 union select 'malware', 'alias' from supplier where s_suppkey % 6 = 0
        union all select 'tool', s_name from supplier where s_suppkey % 2 = 1 union all select 'tool', 'alias' from supplier where s_suppkey % 6 = 3 union all select 'tool', s_name from supplier where s_suppkey % 6 = 3)
    select kind, name, count(*) as n from a group by all
""")
def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    one = lambda kind, once: knowledge.aliases(o, kind, once).groupBy(F.lit(kind).alias("kind"), "name").agg(F.count("*").alias("n"))
    return one("malware", True).union(one("tool", False))


@query("""
    with r as (select row_number() over (order by url) - 1 as id, url from pages where url is not null)
    select cast(id as bigint) as id, url, case when url like '%.pdf' or url like '%.PDF' then 'pdf' else 'html' end as type from r
""")
def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.url_list(_read(spark, sf_dir, "pages"))


@query("""
    with s as (select 'T' || (event_id % 6) as s, case when event_id % 9 = 0 then 'TA' || (event_id % 3) else 'T' || (event_id % 5) end as t, event_id % 4 as k from events),
    x as (select s, t, k from s where t not like 'TA%' union all select s, 'T' || i, k from s, range(0, 6) r(i) where t like 'TA%' and i % 3 = cast(t[3:] as integer)),
    p as (select s as source, t as target from x where k in (1, 2) and s <> t union all select t, s from x where k in (0, 2) and s <> t)
    select source, target, count(*) as n from p group by all
""")
def prior_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    mention = F.when(e % 9 == 0, F.concat(F.lit("TA"), (e % 3).cast("string"))).otherwise(F.concat(F.lit("T"), (e % 5).cast("string")))
    sheet = _read(spark, sf_dir, "events").select(F.concat(F.lit("T"), (e % 6).cast("string")).alias("id"), F.concat(F.lit("as [E1] "), mention, F.lit(" [/E1] said [E1]no[/E1]")).alias("text"), (e % 4).alias("type"))
    return knowledge.associations(sheet, _tactics(spark))


def _tactics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"T{i}", [f"TA{i % 3}"]) for i in range(6)], "tech_id string, tactics array<string>")


@query("""
    with s as (select distinct event_id % 6 as a, event_id % 5 as b from events)
    select distinct 'TA' || (a % 3) as source, 'TA' || (b % 3) as target from s where a <> b and a % 3 <> b % 3
""")
def tactic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pairs = _read(spark, sf_dir, "events").select(F.concat(F.lit("T"), (e % 6).cast("string")).alias("source"), F.concat(F.lit("T"), (e % 5).cast("string")).alias("target")).where("source <> target")
    return knowledge.tactic_pairs(pairs, _tactics(spark))


# ---- techniques: a region's users are a technique's procedures, a user's event types its nodes, neighbouring ones its edges

_GRAPH = """
    e as (select user_id as doc, event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b, event_id from events),
    n as (select user_id as doc, event_type as node, list_sort(list_distinct(list(event_type || '-' || (event_id % 3)))) as texts, [upper(event_type), case when event_type = 'click' then 'ACTOR' else 'OTHER' end] as labels from events group by all),
    d as (select distinct doc, a, b from e where b is not null), t as (select distinct user_id as doc, 'T' || (user_id % 5) as tech_id from events),
    m as (select t.tech_id, n.* from t join n using (doc) where exists (select 1 from d where d.doc = n.doc and n.node in (d.a, d.b)))
"""


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = _read(spark, sf_dir, "events")
    u, t = F.col("user_id"), F.col("event_type")
    nodes = ev.groupBy(u.alias("doc"), t.alias("node_id")).agg(F.array_sort(F.collect_set(F.concat_ws("-", t, (F.col("event_id") % 3).cast("string")))).alias("texts"))
    nodes = nodes.withColumn("labels", F.array(F.upper("node_id"), F.when(F.col("node_id") == "click", "ACTOR").otherwise("OTHER")))
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = ev.select(u.alias("doc"), t.alias("source"), after.alias("target"), F.when(F.col("event_id") % 2 == 0, "use").otherwise("run").alias("verb")).where("target is not null")
    techs = ev.select(F.concat(F.lit("T"), (u % 5).cast("string")).alias("tech_id"), u.alias("doc")).distinct().groupBy("tech_id").agg(F.array_sort(F.collect_set("doc")).alias("procedures"))
    return techs.withColumns({"name": F.lit("click-1"), "tactics": F.array(F.lit("TA0001"))}), nodes, edges


@query(f"""
    with {_GRAPH}, l as (select tech_id, doc, node, texts, unnest(labels) as label from m)
    select tech_id, label, cast(sum(len(texts)) as bigint) as count, cast(len(list_distinct(flatten(list(texts)))) as integer) as n_texts from l group by all
""")
def technique_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return techniques.technique_nodes(*_graphs(spark, sf_dir)).select("tech_id", "label", "count", F.size("texts").alias("n_texts"))


@query(f"""
    with {_GRAPH}, p as (select t.tech_id, unnest(x.labels) as source, y.labels as ys from e join t using (doc) join n x on x.doc = e.doc and x.node = e.a join n y on y.doc = e.doc and y.node = e.b where e.b is not null),
    q as (select tech_id, source, unnest(ys) as target from p)
    select tech_id, source, target, count(*) as count from q where source <> target group by all
""")
def technique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return techniques.technique_edges(*_graphs(spark, sf_dir))


@query(f"""
    with {_GRAPH}, v as (select t.tech_id, case when event_id % 2 = 0 then 'use' else 'run' end as verb from e join t using (doc) where b is not null)
    select tech_id, verb, count(*) as count from v group by all
""")
def technique_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    techs, _, edges = _graphs(spark, sf_dir)
    return techniques.technique_verbs(techs, edges)


@query(f"""
    with {_GRAPH}, l as (select tech_id, texts, unnest(labels) as label from m), c as (select tech_id, label, sum(len(texts)) as n from l where label not in ('ACTOR', 'OTHER') group by all)
    select tech_id, string_agg(label, ' ' order by n desc, label) as features from c group by tech_id
""")
def technique_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = techniques.technique_nodes(*_graphs(spark, sf_dir))
    return techniques.features(counts).select("tech_id", F.array_join("features", " ").alias("features"))


@query("""
    with v as (select vec_id, label, embedding::double[] as e from embeddings),
    p as (select a.label as l, b.label as r, case when a.vec_id = b.vec_id then 1.0 else round(list_cosine_similarity(a.e, b.e), 6) end as c from v a join v b on a.label <> b.label)
    select l as left, r as right, max(c) as context from p where c > 0.2 group by all
""")
def list_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest cosine between the vectors of two labels, as that of two nodes' texts; each block of pairs sends the highest of each two labels."""
    from tracewell.operators import similarity

    v = _read(spark, sf_dir, "embeddings")
    cosines = similarity.all_cosine(v, "vec_id", "embedding", 0.2, top="label")
    texts = v.groupBy("label").agg(F.collect_set("vec_id").alias("texts"))
    found = techniques.most_alike(texts.withColumnRenamed("label", "left"), texts.withColumnRenamed("label", "right"), cosines)
    return found.where("left <> right")


_JUDGED = """
    t as (select distinct user_id % 10 as report, cast(event_id % 12 as integer) as id from events where event_id % 3 = 0),
    p as (select user_id % 10 as report, round(value / 100, 1) as threshold, cast(case when event_id % 5 = 0 then -1 else event_id % 15 end as integer) as id from events where value >= 50)
"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev, e = _read(spark, sf_dir, "events"), F.col("event_id")
    report = (F.col("user_id") % 10).alias("report")
    truth = ev.where("event_id % 3 = 0").select(report, (e % 12).cast("int").alias("id")).distinct()
    predicted = ev.where("value >= 50").select(report, F.when(e % 5 == 0, -1).otherwise(e % 15).cast("int").alias("id"))
    return truth, predicted


@query(f"""
    with {_JUDGED}, a as (select report, list_distinct(list(id) filter (id <> 0)) as t from t group by report), b as (select report, list(id) filter (id <> 0) as p from p group by report),
    c as (select coalesce(a.report, b.report) as report, coalesce(t, []) as t, coalesce(p, []) as p, list_filter(coalesce(p, []), lambda x: x <> -1) as r from a full join b on a.report = b.report),
    d as (select report, len(list_intersect(t, r)) as tp, len(p) - len(r) as fp, len(t) - len(list_intersect(t, r)) as fn, len(r) - len(list_distinct(r)) as dup from c)
    select report, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(dup as bigint) as duplicates, round(coalesce(tp / nullif(tp + fp, 0), 0), 3)::double as precision from d
""")
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses, ids that are not found and duplicates of each report."""
    return techniques.evaluated(*_judged(spark, sf_dir), ["report"]).select("report", "tp", "fp", "fn", "duplicates", "precision")


_SCORES = """
    s as (select user_id as report, [0.98, 0.99, 1.0][event_id % 3 + 1] as threshold, max(round(value / 500, 3)) as precision, min(round(value / 500, 3)) as recall from events group by all)
"""


@query(f"""
    with {_SCORES}, l as (select *, max(case when threshold = 0.99 then precision end) over (partition by report) as last from s),
    e as (select threshold, case when threshold = 1.0 then coalesce(last, 0) else precision end as p, case when threshold = 1.0 then 0 else recall end as r from l),
    m as (select threshold, round(avg(p), 3) as precision, round(avg(r), 3) as recall from e group by threshold)
    select threshold::double as threshold, precision::double as precision, recall::double as recall, coalesce(round(2 * precision * recall / nullif(precision + recall, 0), 3), 0)::double as f2 from m
""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round(F.col("value") / 500, 3)
    t = F.get(F.array(F.lit(0.98), F.lit(0.99), F.lit(1.0)), (F.col("event_id") % 3).cast("int"))
    scores = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("report"), t.alias("threshold")).agg(F.max(v).alias("precision"), F.min(v).alias("recall"))
    return techniques.macro_average(scores.withColumn("f1", F.col("recall"))).select("threshold", "precision", "recall", "f2")


@query("""
    with l as (select user_id as report, floor(value / 100) / 10 as threshold, count(*) as n from events group by all), s as (select user_id as report, count(*) // 6 as attacks from events group by user_id),
    g as (select l.report, threshold, n, abs(n - attacks) as gap from l join s using (report)), b as (select report, min(gap) as least, arg_min(n, threshold) as a, arg_max(n, threshold) as z from g group by report)
    select report, round(avg(threshold), 6) as optimal, any_value(abs(a - z) / 2) as ratio from g join b using (report) where gap = least group by report
""")
def nearest_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    lengths = ev.groupBy(F.col("user_id").alias("report"), (F.floor(F.col("value") / 100) / 10).alias("threshold")).agg(F.count("*").alias("n"))
    scores = ev.groupBy(F.col("user_id").alias("report")).agg(F.expr("count(*) div 6").alias("tp"), F.lit(0).cast("long").alias("fn"))
    found = techniques.nearest_thresholds(lengths, scores)
    return found.select("report", F.round("optimal", 6).alias("optimal"), "ratio")


@query("""
    with e as (select event_type as source, lead(event_type) over (partition by user_id order by ts, event_id) as target from events), c as (select source, target, count(*) as n from e where target is not null and source <> target group by all),
    a as (select source, target, n from c union all select 'view', 'click', 100 union all select 'view', 'none', 5), s as (select source, target, cast(sum(n) as bigint) as n from a group by all),
    w(source, target) as (values ('view', 'click'), ('view', 'none'), ('view', 'nothing'), ('click', 'view'))
    select w.source, w.target, coalesce(n, 0) as n from w left join s on w.source = s.source and w.target = s.target
""")
def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs with prior ones, looked up."""
    from tracewell.operators import paths

    pairs = paths.edges(_read(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")
    prior = spark.createDataFrame([("view", "click", 100), ("view", "none", 5)], "source string, target string, n long")
    wanted = spark.createDataFrame([("view", "click"), ("view", "none"), ("view", "nothing"), ("click", "view")], "source string, target string")
    return techniques.pair_lookup(techniques.with_prior(pairs, prior), wanted, "n")


@query("""
    with n as (select user_id as doc, event_id as node, event_type as text, count(*) over (partition by user_id) as n from events),
    a as (select user_id as report, event_id % 8 as location, event_type as proc, value as score, event_id from events), big as (select event_type as proc from events group by event_type having count(*) > 1)
    select report, cast(location as integer) as location, count(*) as n, max(score) as best from a where proc in (select proc from big) and proc <> 'error' group by all
""")
def alignments_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    a = _read(spark, sf_dir, "events").select(F.col("user_id").alias("report"), (e % 8).cast("int").alias("location"), F.col("event_type").alias("proc"), F.col("value").alias("score"), F.array(e).alias("ats"), F.array(e).alias("sentences"))
    nodes = _read(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_type").alias("proc"))
    found = report_graphs.by_location(a, nodes)
    return found.select("report", "location", F.size("alignments").cast("long").alias("n"), F.array_max(F.transform("alignments", lambda x: x["score"])).alias("best"))


@query(None)
def event_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of users as reports: neighbouring events are subject and object, views are equivalences; sizes of nodes and edges."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = lambda c: F.when(F.col(c).isin("view", "click"), F.array(F.lit("ACTOR"))).otherwise(F.array(F.upper(F.col(c))))
    ev = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"), (F.row_number().over(w) - 1).alias("n"), F.col("event_type").alias("sub"), F.lead("event_type").over(w).alias("obj")
    ).where("obj is not null")
    events = ev.select(
        "doc", F.expr("int(n div 10)").alias("sentence"), "sub", "obj", F.expr("int(n % 10)").alias("sub_id"), F.expr("int(n % 10 + 1)").alias("obj_id"), kinds("sub").alias("sub_label"),
        kinds("obj").alias("obj_label"), F.when(F.col("sub") == "view", "be").otherwise("use").alias("verb"), F.col("n").alias("verb_index"), (F.col("sub") == "view").cast("int").alias("flag"), F.col("n").alias("seq"),
    )
    nodes, edges = report_graphs.event_graph(events, "doc", "sentence")
    n = nodes.groupBy("doc").agg(F.count("*").alias("n_nodes"), F.sum(F.size("ids")).alias("n_merged"))
    return n.join(edges.groupBy("doc").agg(F.count("*").alias("n_edges")), "doc", "left")


@query(r"""
    with p as (select conv_id as k, turn + 1 as page, case when turn % 7 = 1 then 'Contents' || chr(10) || text when turn % 5 = 4 then 'REFERENCES' || chr(10) || text else replace(text, ' a', '-' || chr(10)) end as t from conversations),
    n as (select k, count(*) as n from p group by k), e as (select k, min(page) as stop from p join n using (k) where regexp_matches(t, '(?i)(\n|^)(REFERENCES\n|Acknowledgements\n|Appendix\b)') and 2 * page > n group by k),
    x as (select p.k, page, t from p left join e using (k) where (stop is null or page < stop) and t is not null and not regexp_matches(t, '(?i)(\n|^)(table of contents|contents|list of figures|list of tables)\n'))
    select k as conv_id, md5(trim(replace(string_agg(trim(t), ' ' order by page, trim(t)), '-' || chr(10), ''))) as digest from x group by k
""")
def paged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as printed pages: contents left out, cut at the references past the middle, broken words joined."""
    t, text = F.col("turn"), F.col("text")
    said = F.when(t % 7 == 1, F.concat(F.lit("Contents\n"), text)).when(t % 5 == 4, F.concat(F.lit("REFERENCES\n"), text)).otherwise(F.replace(text, F.lit(" a"), F.lit("-\n")))
    pages = _read(spark, sf_dir, "conversations").select("conv_id", (t + 1).alias("page"), said.alias("text"))
    return reports.paged_reports(pages, "conv_id").select("conv_id", F.md5("text").alias("digest"))
