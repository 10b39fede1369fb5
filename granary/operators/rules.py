"""Large rule tables: hosts and path prefixes by equality joins, and many terms in one reading of a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.web import host_of, path_of


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains, with its port: a.b.c gives a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def allowed_domains(urls: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """urls whose host is one of domains (domain) or a subdomain of one; a table of any size, met by equality."""
    known = domains.select(F.lower("domain").alias("_suffix")).filter("_suffix <> ''").distinct()
    each = urls.select(F.col(url).alias("_url")).distinct().filter("_url is not null")
    hit = each.withColumn("_suffix", F.explode(host_suffixes(host_of(F.col("_url"))))).join(known, "_suffix", "left_semi").select("_url").distinct()
    return urls.join(hit, urls[url] == hit["_url"], "left_semi")


def matching_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, ord, host, prefix, verdict) of every rule (ord, host, prefix, verdict) that fits a distinct url.

    A rule fits its host and all subdomains where the path starts with its prefix. Urls are exploded into host suffixes and
    those path prefixes whose length some rule has, rules are met by equality on both: work grows with urls, not with
    urls times rules. The lengths are distinct numbers, as many as the longest prefix has characters at most.
    """
    known = rules.select("ord", F.lower("host").alias("host"), F.coalesce("prefix", F.lit("")).alias("prefix"), "verdict")
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())
    each = urls.select(F.col(url).alias("url")).distinct().filter("url is not null").withColumn("_path", path_of(F.col("url")))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    hosts = each.withColumn("host", F.explode(host_suffixes(host_of(F.col("url"))))).join(known.select("host").distinct(), "host", "left_semi")
    return hosts.select("url", "host", F.explode(starts).alias("prefix")).join(known, ["host", "prefix"]).select("url", "ord", "host", "prefix", "verdict")


def longest_rule(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with rule_ord and rule_verdict of the rule of the longest host and prefix together, the first of equal ones; null where none fits."""
    rank = F.struct(F.length("host") + F.length("prefix"), -F.col("ord"))
    best = matching_rules(urls, rules, url).groupBy("url").agg(F.max_by(F.struct("ord", "verdict"), rank).alias("_r"))
    best = best.select(F.col("url").alias("_url"), F.col("_r.ord").alias("rule_ord"), F.col("_r.verdict").alias("rule_verdict"))
    return urls.join(best, urls[url] == best["_url"], "left").drop("_url")


def first_rule(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with rule_ord and rule_verdict of the first rule that fits, in order of ord; null where none does."""
    best = matching_rules(urls, rules, url).groupBy("url").agg(F.min_by(F.struct("ord", "verdict"), "ord").alias("_r"))
    best = best.select(F.col("url").alias("_url"), F.col("_r.ord").alias("rule_ord"), F.col("_r.verdict").alias("rule_verdict"))
    return urls.join(best, urls[url] == best["_url"], "left").drop("_url")


def found_terms(df: DataFrame, column: str, terms: list[str], out: str = "terms") -> DataFrame:
    """df with out, the numbers of the terms that are substrings of the lower-cased text, in order; one reading of a text.

    An Aho-Corasick automaton of all terms is built once a task and follows a text character by character, so the time
    does not grow with the number of terms. Empty terms are in every text that is not null; a null text has none.
    """
    lower = [t.lower() for t in terms]
    names = [f.name for f in df.schema]
    held = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.lower(F.col(f"`{column}`")).alias("text"))
    schema = T.StructType([T.StructField("row", held.schema["row"].dataType), T.StructField("terms", T.ArrayType(T.IntegerType()))])
    sent = df.sparkSession.sparkContext.broadcast(lower)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for k, t in enumerate(sent.value):
            numbers.setdefault(t, []).append(k)
        always = numbers.pop("", [])
        machine = ahocorasick.Automaton()
        for t, ks in numbers.items():
            machine.add_word(t, ks)
        if numbers:
            machine.make_automaton()
        for b in batches:
            hits = []
            for text in b.column("text").to_pylist():
                seen = set(always) if text is not None else set()
                if text and numbers:
                    for _, ks in machine.iter(text):
                        seen.update(ks)
                hits.append(sorted(seen))
            yield pa.record_batch([b.column("row"), pa.array(hits, pa.list_(pa.int32()))], ["row", "terms"])

    made = held.mapInArrow(run, schema)
    return made.select(*[F.col("row").getField(n).alias(n) for n in names if n != out], F.col("terms").alias(out))


def categorise_by_terms(df: DataFrame, column: str, rules: list[tuple[str, list[str]]], out: str = "category") -> DataFrame:
    """categorise() for any number of terms: the first rule with a term in the text, else Other."""
    terms = [t for _, ts in rules for t in ts]
    label = [k for k, (_, ts) in enumerate(rules) for _ in ts]
    hit = found_terms(df, column, terms, "_terms")
    # rules come in order, so the first term found belongs to the first rule
    first = F.element_at(F.array(*[F.lit(n) for n, _ in rules]), F.element_at(F.array(*map(F.lit, label)), F.col("_terms")[0] + 1) + 1) if terms else F.lit(None)
    chosen = F.when(F.size("_terms") > 0, first).otherwise("Other")
    return hit.withColumn(out, chosen).drop("_terms")


def covered_groups(df: DataFrame, column: str, groups: list[list[str]], out: str = "covered") -> DataFrame:
    """df with the numbers of the groups of synonyms of which one at least is in the text."""
    terms = [t for g in groups for t in g]
    of = [k for k, g in enumerate(groups) for _ in g]
    hit = found_terms(df, column, terms, "_terms")
    number = F.array(*map(F.lit, of)) if of else F.array().cast("array<int>")
    return hit.withColumn(out, F.array_sort(F.array_distinct(F.transform("_terms", lambda t: F.element_at(number, t + 1))))).drop("_terms")
