"""URL filter: pattern rules indexed by their rarest literal token.

A rule has literal tokens (runs of letters and digits of its host and path) and two regular expressions, for the host and
for the path. Each rule is filed under the one of its tokens that the fewest URLs contain. The tokens of a URL fetch the
rules filed under them, and only these candidates run their regular expressions; the longest rule that fits decides.

All of it is DataFrame work: distinct URLs first, so a URL or host with a third of all rows is judged once; one index for
the given rules and the method's own, joined on the token (Spark broadcasts it if it is small by its own measure, else the
join shuffles and may be split).

Defined cases: a URL that is null or has no ``://`` has empty host and path and fits no rule; repeated rows are judged
each; ties between rules of equal length go to the smaller rule text; line feeds and other control characters in a URL are
characters like any other; an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

TOKEN = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """host: fits it and all its subdomains, path: what the URL's path starts with. With ``pattern``, both are instead regular
    expressions found anywhere in the URL's; ``literals`` are then tokens that every match contains whole."""

    verdict: str
    host: str
    path: str = ""
    pattern: bool = False
    literals: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regexes(self) -> tuple[str, str]:
        """For host and path."""
        if self.pattern:
            return self.host, self.path
        return rf"(?s)\A(?:.*\.)?{re.escape(self.host)}\z", rf"\A{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens: of the host all, of a path prefix those that end inside it."""
        if self.pattern:
            return [t.lower() for t in self.literals]
        parts = re.split(TOKEN, self.path.lower())
        return [t for t in re.split(TOKEN, self.host) + parts[:-1] if t]


#: The contract's rules.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Host name tokens of advertising, gambling, adult and fraud sites.
JUNK_TOKENS = "ads adserver adult bets betting casino doubleclick gambling malware phishing pills porn spam track tracker viagra warez xxx".split()
#: The method's own rules where none of those fits: junk hosts, and paths that hold no prose.
OWN_RULES = tuple(Rule("block", rf"(?:\A|[.-]){t}(?:[.-]|\z)", "", True, (t,)) for t in JUNK_TOKENS) + (
    Rule("block", "", r"/wp-login\.php(?:/|\z)", True, ("login", "php")),
    Rule("block", "", "/cgi-bin/", True, ("cgi", "bin")),
    Rule("block", "", "/adserver/", True, ("adserver",)),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat_ws("/", host, path)), TOKEN))


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(spark: SparkSession, sets: tuple[tuple[Rule, ...], ...]) -> DataFrame:
    """_set, _no, _rule, _verdict, _hosts, _paths, _token: a row for each token of each rule, as a local relation."""
    rows, no = [], 0
    for number, rules in enumerate(sets):
        if bare := [r.text for r in rules if not r.tokens]:
            raise ValueError(f"rules without a literal token can't be indexed: {bare}")
        for rule in rules:
            no += 1
            rows += [(number, no, *map(_quoted, (rule.text, rule.verdict, *rule.regexes, token))) for token in dict.fromkeys(rule.tokens)]
    values = ", ".join(f"({', '.join(map(str, row))})" for row in rows) or "(0, 0, '', '', '', '', '')"
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(_set, _no, _rule, _verdict, _hosts, _paths, _token)")
    return table if rows else table.where("false")


def best_rules(urls: DataFrame, *sets: tuple[Rule, ...]) -> DataFrame:
    """urls: distinct _host, _path. _host, _path and, for each set of rules, the longest fitting one (_rule<i>, _verdict<i>,
    null if none fits) of each URL that any rule fits."""
    table = _table(urls.sparkSession, sets)
    exploded = urls.select("_host", "_path", F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("_token"))
    named = table.select("_token").distinct()
    frequency = exploded.join(named, "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    rarity = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("t"))
    columns = ("_set", "_no", "_rule", "_verdict", "_hosts", "_paths")
    index = table.join(frequency, "_token", "left").groupBy(*columns).agg(F.min(rarity)["t"].alias("_token"))
    candidates = exploded.join(index, "_token")
    fitting = candidates.where(F.expr("_host rlike _hosts") & F.expr("_path rlike _paths"))
    longest = F.struct((-F.length("_rule")).alias("l"), F.col("_rule").alias("r"), F.col("_verdict").alias("v"))
    best = fitting.groupBy("_host", "_path").agg(*[F.min(F.when(F.col("_set") == i, longest)).alias(f"_b{i}") for i in range(len(sets))])
    found = [F.col(f"_b{i}.{a}").alias(f"{b}{i}") for i in range(len(sets)) for a, b in (("r", "_rule"), ("v", "_verdict"))]
    return best.select("_host", "_path", *found)


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    own_rules: tuple[Rule, ...] = OWN_RULES,
    default: str = "allow",
    url_col: str = "url",
    id_col: str = "page_id",
) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    judged = best_rules(rows.select("_host", "_path").distinct(), rules, own_rules)
    return rows.join(judged, ["_host", "_path"], "left").select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule0").alias("rule"),
        F.coalesce("_verdict0", "_verdict1", F.lit(default)).alias("verdict"),
    )
