"""Query rules as tables, matched by joins.

The planner takes rules as constants of its expressions, which suits dozens. Here they are rows:

    phrases  rule, phrase, domain, terms, tasks     held where the normalised query contains the phrase
    combos   rule, tokens, domain, terms, tasks     held where all tokens are among the query's focus terms
    tokens   token, domain, terms                   held for a focus term

``rule`` is the order of rules of a kind. Combinations are a relational division by pairs: a combination is joined by its
first two tokens with the pairs of a query's terms, so a common token alone meets nothing; any others are looked up
in the query's terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import containment

#: Points of a rule of several words and of one word for its domain; domains of a query.
RULE_POINTS, TOKEN_POINTS, DOMAINS = 2, 1, 3
#: Combinations that are broadcast; more are joined by shuffle.
BROADCAST_COMBOS = 1_000_000


@dataclass
class RuleTables:
    phrases: DataFrame
    combos: DataFrame
    tokens: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, rules: V.Rules) -> RuleTables:
        """The tables of rules given as lists. Of several rules for a token the last counts, as in a map."""
        rule = "domain string, terms array<string>, tasks array<string>"
        tokens = {t: (t, d, terms) for t, d, terms in rules.tokens}
        return cls(
            spark.createDataFrame([(i, *r) for i, r in enumerate(rules.phrases)], f"rule long, phrase string, {rule}"),
            spark.createDataFrame([(i, *r) for i, r in enumerate(rules.combos)], f"rule long, tokens array<string>, {rule}"),
            spark.createDataFrame(list(tokens.values()), "token string, domain string, terms array<string>"),
        )

    def without(self) -> RuleTables:
        """No rule at all."""
        return RuleTables(self.phrases.limit(0), self.combos.limit(0), self.tokens.limit(0))


def held_combos(terms: DataFrame, combos: DataFrame) -> DataFrame:
    """(query_id, rule) for the combinations all of whose tokens a query has; terms: (query_id, token), no repeats. A combination without tokens holds for none."""
    # A token of null is met by no term.
    parts = combos.select("rule", F.array_sort(F.array_distinct("tokens")).alias("k")).where((F.size("k") > 0) & ~F.exists("k", lambda t: t.isNull()))
    parts = parts.select("rule", F.slice("k", 1, 2).alias("key"), F.slice("k", 3, F.greatest(F.size("k") - 2, F.lit(0))).alias("rest"))
    n, longest = parts.agg(F.count("*"), F.max(F.size("rest"))).first()
    hint = F.broadcast if n <= BROADCAST_COMBOS else lambda d: d
    known = terms.join(hint(parts.select(F.explode(F.concat("key", "rest")).alias("token")).distinct()), "token", "left_semi")
    own = known.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("ts"))
    ones = F.transform("ts", lambda x: F.array(x))
    pairs = F.flatten(F.transform("ts", lambda x, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda y: F.array(x, y))))
    found = own.select("query_id", F.explode(F.concat(ones, pairs)).alias("key")).join(hint(parts), "key").select("query_id", "rule", "rest")
    if not longest:
        return found.select("query_id", "rule")
    more = found.where(F.size("rest") > 0).join(own.withColumnRenamed("query_id", "q"), F.col("query_id").eqNullSafe(F.col("q"))).where(F.size(F.array_except("rest", "ts")) == 0)
    return found.where(F.size("rest") == 0).select("query_id", "rule").unionAll(more.select("query_id", "rule"))


def matches(queries: DataFrame, tables: RuleTables) -> DataFrame:
    """(query_id, kind, place, points, domain, terms, tasks): rules held by (query_id, normalized_query, raw_focus_terms); kind 0 phrases, 1 combinations, 2 tokens; place is the rule's, for tokens the term's."""
    terms = queries.select("query_id", F.posexplode(F.array_distinct("raw_focus_terms")).alias("place", "token"))
    found = containment.contains_join(queries, tables.phrases, "query_id", "normalized_query", "rule", "phrase").withColumnsRenamed({"doc_id": "query_id", "phrase_id": "rule"})
    about = [F.lit(RULE_POINTS).alias("points"), "domain", "terms", "tasks"]
    phrases = found.join(tables.phrases, "rule").select("query_id", F.lit(0).alias("kind"), F.col("rule").cast("long").alias("place"), *about)
    combos = held_combos(terms, tables.combos).join(tables.combos, "rule").select("query_id", F.lit(1).alias("kind"), F.col("rule").cast("long").alias("place"), *about)
    none = F.array().cast("array<string>").alias("tasks")
    tokens = terms.join(tables.tokens, "token").select("query_id", F.lit(2).alias("kind"), F.col("place").cast("long").alias("place"), F.lit(TOKEN_POINTS).alias("points"), "domain", "terms", none)
    return phrases.unionAll(combos).unionAll(tokens)


def concepts(queries: DataFrame, tables: RuleTables) -> DataFrame:
    """Q5: ``queries`` with concept_phrases, concept_terms, domains and task_terms, as the planner's expressions give them: in order of kind and rule; domains by points, ties to the first seen."""
    own = matches(queries, tables).groupBy(F.col("query_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("kind", "place", "points", "domain", "terms", "tasks"))).alias("m"))
    df = queries.join(own, F.col("query_id").eqNullSafe(F.col("of")), "left").drop("of")
    none = F.array().cast("array<string>")
    of = lambda part, field: F.coalesce(F.flatten(F.transform(part, lambda x: x[field])), none)
    rules = F.filter("m", lambda x: x["kind"] < 2)
    pointed = F.filter("m", lambda x: x["domain"].isNotNull())
    names = F.array_distinct(F.transform(pointed, lambda x: x["domain"]))
    total = lambda d: F.aggregate(F.filter(pointed, lambda x: x["domain"] == d), F.lit(0), lambda s, x: s + x["points"])
    ordered = F.array_sort(F.transform(names, lambda d, i: F.struct((-total(d)).alias("neg"), i.alias("place"), d.alias("d"))))
    words = F.filter(F.flatten(F.transform(of(F.col("m"), "terms"), T.tokens)), lambda t: ~t.isin(V.STOPWORDS))
    return df.withColumns({
        "concept_phrases": F.array_distinct(of(rules, "terms")), "concept_terms": F.coalesce(F.array_distinct(words), none),
        "domains": F.coalesce(F.transform(F.slice(ordered, 1, DOMAINS), lambda x: x["d"]), none), "task_terms": F.array_distinct(of(rules, "tasks")),
    }).drop("m")
