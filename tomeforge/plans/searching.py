"""Registered queries over the written index, beside SQL that scans the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.catalog import register, table
from tomeforge.operators import search
from tomeforge.runtime import shared_folder

_WORDS = r"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_BM25 = "greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6::double) * f{i} * 2.2::double / (f{i} + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))"


def ranked_sql(question: str) -> str:
    """The ten best documents for a question, its terms as prefixes."""
    terms = search.query_terms(question)
    counts = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}')))::double f{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"sum((f{i} > 0)::int)::double df{i}" for i in range(len(terms)))
    score, hit = " + ".join(_BM25.format(i=i) for i in range(len(terms))), " + ".join(f"f{i}" for i in range(len(terms)))
    return f"""with t as (select doc_id, {_WORDS.format("text")} w from documents),
    c as (select doc_id, len(w)::double dl, {counts} from t), s as (select count(*)::double n, avg(dl) avgdl, {dfs} from c)
    select doc_id, round(-({score}), 6) as score from c, s where {hit} > 0 order by -({score}), doc_id limit 10"""


QUESTION = "what is the edan and thion"
register("ranked_search", lambda s, d: search.ranked(table(s, d, "documents"), "doc_id", "text", QUESTION).select("doc_id", F.round("score", 6).alias("score")), ranked_sql(QUESTION))

ARRIVED = "Über the ÉTRE und für"


def _grown(s: SparkSession, d: str) -> search.Index:
    """The index of all documents, after it grew: first those in English and wrong texts of others; then each other language's documents
    came or took the place of the wrong ones, and rows that are no documents went."""
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    lang = F.coalesce("lang", F.lit("none"))
    wrong = docs.filter(lang == "fr").withColumn("text", F.lit("the the über étre und"))
    strange = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("étre étre").alias("text"), "lang")
    index = search.Index(s, shared_folder(s), "doc_id").build(docs.filter(lang == "en").unionByName(wrong).unionByName(strange), "text")
    for own in (lang == "fr", lang == "de", ~lang.isin("en", "fr", "de")):
        index.refresh(docs.filter(own))
    return index.refresh(docs.limit(0), strange)


register("indexed_search", lambda s, d: _grown(s, d).search(ARRIVED).select("doc_id", F.round("score", 6).alias("score")), ranked_sql(ARRIVED))

_STARTS = "len(list_filter(generate_series(1, len(w)), lambda i: {})) > 0"
#: Each form of a search expression and what it says about the words w of a text and l of its language.
EXPRESSIONS = {
    "the AND de": "list_contains(w, 'the') and list_contains(list_concat(w, l), 'de')",
    "Étre OR über": "list_contains(w, 'etre') or list_contains(w, 'uber')",
    "the NOT of": "list_contains(w, 'the') and not list_contains(w, 'of')",
    "der die": "list_contains(w, 'der') and list_contains(w, 'die')",
    '"of the"': "contains(j, ' of the ')",
    '"de la" + le*': "contains(j, ' de la le')",
    "éti*": "len(list_filter(w, lambda x: starts_with(x, 'eti'))) > 0",
    "^la": "w[1] = 'la'",
    "lang: fr": "list_contains(l, 'fr')",
    "- text: de": "list_contains(l, 'de')",
    "{lang text}: es": "list_contains(w, 'es') or list_contains(l, 'es')",
    "lang: fr NOT text: que": "list_contains(l, 'fr') and not list_contains(w, 'que')",
    "NEAR(der die, 3)": _STARTS.format("(w[i] = 'der' and list_contains(w[i:i + 4], 'die')) or (w[i] = 'die' and list_contains(w[i:i + 4], 'der'))"),
    'NEAR("of the" and, 1)': _STARTS.format("(w[i] = 'of' and w[i + 1] = 'the' and list_contains(w[i:i + 3], 'and')) or (w[i] = 'and' and ((w[i + 1] = 'of' and w[i + 2] = 'the') or (w[i + 2] = 'of' and w[i + 3] = 'the')))"),
    "(the OR der) AND (of OR die) NOT (fr* OR le)": "(list_contains(w, 'the') or list_contains(w, 'der')) and (list_contains(w, 'of') or list_contains(w, 'die')) and not (len(list_filter(list_concat(w, l), lambda x: starts_with(x, 'fr'))) > 0 or list_contains(w, 'le'))",
    "the AND (of": "contains(j, ' the and of ')",  # no expression: the literal phrase
}


def _expressions(s: SparkSession, d: str) -> DataFrame:
    index = search.Index(s, shared_folder(s), "doc_id").build(table(s, d, "documents").select("doc_id", "text", "lang"), "text", "lang")
    found = [index.scores(index.expression(e)).select(F.lit(e).alias("expression"), "doc_id") for e in EXPRESSIONS]
    return reduce(DataFrame.unionByName, found)


register(
    "search_expressions",
    _expressions,
    f"with t as (select doc_id, {_WORDS.format('text')} w, {_WORDS.format('lang')} l from documents), k as (select *, ' ' || array_to_string(w, ' ') || ' ' j from t) " + " union all ".join(f"select '{e}' as expression, doc_id from k where {p}" for e, p in EXPRESSIONS.items()),
)


def _entities(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat_ws(" ", "p_brand", "p_type").alias("snippet"))
    index = search.Index(s, shared_folder(s), "id").build(parts, "name", "snippet")
    return search.entity_search(index, "small NOT ring OR name: bolt* OR snippet: 17", "ECONOMY")


register(
    "entity_search",
    _entities,
    f"""with t as (select p_partkey id, p_name as name, p_type as type, p_brand || ' ' || p_type as snippet, {_WORDS.format("p_name")} a, {_WORDS.format("p_brand || ' ' || p_type")} b from part),
    c as (select *, (len(a) + len(b))::double dl, len(list_filter(list_concat(a, b), lambda x: x = 'small'))::double f0, len(list_filter(list_concat(a, b), lambda x: x = 'ring'))::double f1,
        len(list_filter(a, lambda x: starts_with(x, 'bolt')))::double f2, len(list_filter(b, lambda x: x = '17'))::double f3 from t),
    s as (select count(*)::double n, avg(dl) avgdl, {", ".join(f"sum((f{i} > 0)::int)::double df{i}" for i in range(4))} from c)
    select name, type, snippet from c, s where type = 'ECONOMY' and ((f0 > 0 and not f1 > 0) or f2 > 0 or f3 > 0) order by -({" + ".join(_BM25.format(i=i) for i in range(4))}), name, id limit 20""",
)
