"""Source divergence audit (operator 11): how far the word shares of the sources of a language lie apart.

Duplicate-text collapse: the rows of a language are grouped by text (by its SHA-256) with the number of rows per source;
each text is then tokenized once, and its terms enter document frequencies and counts weighted by those numbers. The text
itself travels once, in a group that every task shrinks to one text before the shuffle, so a text that a third of all
rows repeat costs no more than one.

Shares are ``p = 1 + floor(10^9 (count + 1) / (N + V))``, the divergence of a term is ``f = floor((p - q)^2 / q)``. The sum
over all V kept terms of a language for a pair of sources is taken sparsely. With ``p0`` the share of an absent term::

    sum f = sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]
          + sum over terms of s f(p, q0) + sum over terms of t f(p0, q) + (V - terms of s - terms of t) f(p0, q0)

so only terms that both sources hold are joined; the sums over one source need its number of terms per count. The report
itself has a row for each pair of sources of a language, so its size, and the join by term, grow with the square of the
number of sources; terms of very many sources are dealt out over several tasks.

NULL text, lang and source count as empty. Repeated rows count each; empty texts and rows without terms still name their
group; an empty table gives an empty result. Ties go to the smaller item in UTF-8 order. Texts of any length are read
whole. Only the three named columns are read, so other columns may have any name. All arithmetic is on whole numbers; one
that does not fit 64 bits fails loudly.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.functions.regex import let, once
from gazeledger.llm.common import materialise

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
SHARE = 1_000_000_000
SOURCES_A_TASK = 256  # a term of more sources is dealt out


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def tallied(tokens: Column) -> Column:
    """ARRAY<STRUCT<term, n>> of an array: sorted, then cut where the value changes; NULL if it is empty."""

    def cut(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return F.when(F.size(ordered) > 0, let(starts, lambda begin: F.transform(begin, lambda at, i: F.struct(
            F.get(ordered, at).alias("term"),
            (F.coalesce(F.get(begin, i + 1), F.size(ordered)) - at).cast("bigint").alias("n")))))

    return let(F.sort_array(tokens), cut)


def weighted_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``lang, source, term, n, documents`` over all rows, and all ``lang, source`` groups. Both are written tables."""
    named = {"text": text_col, "lang": lang_col, "source": source_col}
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in named.items()])
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = materialise(rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("rows")), "copies")
    texts = rows.where("text <> ''").groupBy("lang", "digest").agg(F.first("text").alias("text"))
    # a list holds at most the sources of a language, each once
    held = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "rows")).alias("held"))
    tokens = texts.join(held, ["lang", "digest"]).select(
        "lang", "held", once(tallied(F.split(lower_ascii(F.col("text")), BETWEEN_TERMS))).alias("terms"))
    terms = tokens.select("lang", "held", F.explode("terms").alias("t")).where("t.term <> ''")
    each = terms.select("lang", F.inline("held"), F.col("t.term").alias("term"), F.col("t.n").alias("times"))
    counts = each.groupBy("lang", "source", "term").agg(F.sum(F.col("rows") * F.col("times")).alias("n"), F.sum("rows").alias("documents"))
    return materialise(counts, "counts"), materialise(copies.select("lang", "source").distinct(), "groups")


def _share(count: Column, all_terms: Column, kept: Column) -> Column:
    wide = F.lit(SHARE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, (all_terms + kept).cast("decimal(20,0)"))


def _apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources of the language by the summed
    divergence, part ``term`` the ``top`` terms that the source uses more than its language does."""
    counts, groups = weighted_counts(docs, text_col, lang_col, source_col)
    kept = materialise(
        counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.count("*").alias("sources"))
        .where(F.col("documents") >= least).drop("documents"), "kept")
    langs = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")), "lang", "left")
    langs = langs.select("lang", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("v", "lang_n")])
    own = counts.join(kept, ["lang", "term"])
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.count("*").alias("terms"))
    sources = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", "v", "lang_n", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("source_n", "terms")])
    sources = materialise(sources.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("source_n"), F.col("v")))), "sources")
    shares = materialise(
        own.join(sources, ["lang", "source"]).select(
            "lang", "source", "term", "n", "p0", "sources",
            _share(F.col("n"), F.col("source_n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")), "shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    over = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    pairs = _pair_sums(shares, sources).withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(over)


def _pair_sums(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` for every two sources of a language."""
    deals = F.ceil(F.col("sources") / SOURCES_A_TASK).cast("int")
    left = shares.select(
        "lang", "term", F.col("source").alias("s"), F.col("p").alias("ps"), F.col("p0").alias("ps0"), F.pmod(F.xxhash64("source"), deals).cast("int").alias("deal"))
    right = shares.select(
        "lang", "term", F.col("source").alias("t"), F.col("p").alias("pt"), F.col("p0").alias("pt0"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    both = left.join(right, ["lang", "term", "deal"]).where("s < t").groupBy("lang", "s", "t")
    change = [
        F.sum(_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias(name)
        for name, p, q, p0, q0 in (("forth", "ps", "pt", "ps0", "pt0"), ("back", "pt", "ps", "pt0", "ps0"))]
    met = both.agg(*change)
    met = met.select("lang", F.inline(F.array(
        F.struct(F.col("s").alias("source"), F.col("t").alias("item"), F.col("forth").alias("change")),
        F.struct(F.col("t").alias("source"), F.col("s").alias("item"), F.col("back").alias("change")))))

    ends = sources.select("lang", "source", "v", "terms", "p0")
    other = ends.select("lang", F.col("source").alias("item"), F.col("terms").alias("other_terms"), F.col("p0").alias("q0"))
    pairs = ends.join(other, "lang").where("source <> item")
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    of_source = alike.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * _apart("p", "q0")).alias("forward"))
    of_item = alike.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "times").join(ends.drop("v", "terms"), "lang").where("source <> item")
    of_item = of_item.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * _apart("p0", "q")).alias("backward"))
    key = ["lang", "source", "item"]
    wide = [F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)") for c in ("forward", "backward", "change")]
    rest = F.when(F.col("v") > 0, (F.col("v") - F.col("terms") - F.col("other_terms")).cast("decimal(38,0)") * _apart("p0", "q0")).otherwise(F.lit(0))
    return pairs.join(of_source, key, "left").join(of_item, key, "left").join(met, key, "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", (wide[0] + wide[1] + wide[2] + rest).cast("bigint").alias("value"))


ORACLE = rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents),
groups as (select distinct lang, source from d),
kept as (select lang, term from (select lang, unnest(list_distinct(w)) as term from d) group by lang, term having count(*) >= {LEAST_DOCUMENTS}),
c as (select lang, source, term, count(*) as n from (select lang, source, unnest(w) as term from d) semi join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
tot as (select lang, source, sum(n) as n from c group by lang, source),
ltot as (select lang, sum(n) as n from c group by lang),
lc as (select lang, term, sum(n) as n from c group by lang, term),
shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
  1 + ({SHARE}::hugeint * (coalesce(c.n, 0) + 1)::hugeint) // (coalesce(tot.n, 0) + v.v)::hugeint as p,
  1 + ({SHARE}::hugeint * (lc.n + 1)::hugeint) // (ltot.n + v.v)::hugeint as q
  from groups g join kept k on k.lang = g.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join tot on tot.lang = g.lang and tot.source = g.source join lc on lc.lang = g.lang and lc.term = k.term join ltot on ltot.lang = g.lang),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select g.lang, g.source, 'pair' as part, h.source as item, cast(coalesce(s.value, 0) as bigint) as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source left join sums s on s.lang = g.lang and s.source = g.source and s.item = h.source),
terms as (select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // q as bigint) as value from shares where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP_TERMS}"""
