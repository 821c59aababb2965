"""URL rules found through the rarest literal token of their pattern."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import lower_ascii

TOKEN = "[A-Za-z0-9]+"
#: Rules up to this number are sent to all tasks; more are joined by token.
SMALL_RULES = 20_000


class Rule(NamedTuple):
    """A pattern over host and path, the whole tokens every match must hold, and its rank."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int


def quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", text)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains whose path starts with ``path``."""
    whole = re.findall(TOKEN, host) + re.findall(rf"(?<![A-Za-z0-9]){TOKEN}(?=[^A-Za-z0-9])", path)
    return Rule(host + path, f"^([^/]*\\.)?{quote(host)}{quote(path)}", verdict, tuple(whole), len(host) + len(path))


#: The stated rules.  Fixed values.
RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: What the method itself blocks where no stated rule fits.
PATTERNS = (
    Rule("*/login/", "^[^/]*/([^/]*/)*login(/|$)", "block", ("login",), 0),
    Rule("*/cart/", "^[^/]*/([^/]*/)*cart(/|$)", "block", ("cart",), 0),
    Rule("ads.*", "^([^/]*\\.)?ads[.-]", "block", ("ads",), 0),
    Rule("adult.*", "^([^/]*\\.)?adult[.-]", "block", ("adult",), 0),
    Rule("casino.*", "^([^/]*\\.)?casino[.-]", "block", ("casino",), 0),
    Rule("*bets.*", "^([^/]*[.-])?bets[.-]", "block", ("bets",), 0),
)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    patterns: Sequence[Rule] = PATTERNS,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict of every URL: the longest fitting rule's, else a fitting pattern's, else ``default``.

    Each rule is filed under the one of its literal tokens that the fewest
    distinct addresses hold (ties: the smaller token); a rule without tokens is
    tried on every address.  Addresses are reduced to distinct (host, path),
    their tokens fetch candidate rules, and only those run their expression.

    Returns ``(page_id, host, path, rule, verdict)``, one row per row of
    ``pages``.  Null URLs and those without ``://`` have empty host and path.
    ``rule`` is null unless one of ``rules`` fits.  Other columns are not read;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    form = "://([^/?#]*)([^?#]*)"
    url = pages[url_col]
    parsed = pages.select(
        pages[id_col].alias("page_id"),
        F.coalesce(lower_ascii(F.regexp_extract(url, form, 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, form, 2), F.lit("")).alias("path"),
    )
    addresses = parsed.select("host", "path").distinct().withColumn("target", F.concat("host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all("target", F.lit(TOKEN), F.lit(0)))
    small = len(rules) + len(patterns) <= SMALL_RULES

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    given = [(i, r.name, r.pattern, r.verdict, list(r.tokens), r.rank, i < len(rules)) for i, r in enumerate((*rules, *patterns))]
    book = spark.createDataFrame(
        given, "rule_id int, name string, pattern string, verdict string, tokens array<string>, rank int, stated boolean"
    )
    filed = book.select("rule_id", F.explode("tokens").alias("rule_token"))
    words = filed.select(F.col("rule_token").alias("word")).distinct()
    by_word = addresses.select(F.explode(tokens).alias("token"))
    held = by_word.join(sent(words), F.col("token") == F.col("word"), "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    rarest = (
        filed.join(held, F.col("rule_token") == F.col("token"), "left")
        .groupBy("rule_id")
        .agg(F.min_by("rule_token", F.struct(F.coalesce("held", F.lit(0)), "rule_token")).alias("filed_under"))
    )
    index = book.join(rarest, "rule_id", "left").withColumn("filed_under", F.coalesce("filed_under", F.lit("")))

    fits = (
        addresses.select("host", "path", "target", F.explode(F.array_append(tokens, F.lit(""))).alias("token"))
        .join(sent(index), F.col("token") == F.col("filed_under"))
        .filter("target rlike pattern")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("name", "verdict", "stated"), F.struct("stated", "rank", "name")).alias("best"))
        .select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best")
    )
    same = (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))
    return parsed.join(fits, same, "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.stated"), F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The same in DuckDB SQL.
JUDGE_SQL = r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
r(verdict, rh, rp) as (values ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
a as (select distinct host, path from p),
f as (select host, path, max_by(struct_pack(n := rh || rp, v := verdict), length(rh || rp)) as best
      from a join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
      group by host, path)
select p.page_id, p.host, p.path, best.n as rule,
       coalesce(best.v, case when regexp_matches(p.host || p.path, '^[^/]*/([^/]*/)*(login|cart)(/|$)')
                               or regexp_matches(p.host || p.path, '^([^/]*\.)?(ads|adult|casino)[.-]')
                               or regexp_matches(p.host || p.path, '^([^/]*[.-])?bets[.-]') then 'block' else 'allow' end) as verdict
from p left join f on p.host = f.host and p.path = f.path
"""
