"""Text and JSON functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def has_phrase(text: Column, required: Sequence[str], avoided: Sequence[str] = ()) -> Column:
    """Whether text contains any required phrase and no avoided one."""
    any_of = lambda phrases: F.greatest(*(F.when(text.contains(p), 1).otherwise(0) for p in phrases), F.lit(0)) == 1
    return any_of(required) & ~any_of(avoided)


def json_fields(df: DataFrame, column: str, **paths: str) -> DataFrame:
    """df with a string column for each JSON path."""
    return df.withColumns({k: F.get_json_object(column, p) for k, p in paths.items()})


def word_score(text: Column, good: Sequence[str], bad: Sequence[str]) -> Column:
    """Words of good less words of bad, over the number of words (a lexicon's sentiment)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    count = lambda names: F.size(F.filter(words, lambda w: w.isin(*names)))
    return F.try_divide(count(good) - count(bad), F.size(words))


# The paths of a message's followers and of the message that it passes on, and what its text is rid of.
FOLLOWERS, RETWEETS = "$.user.followers_count", "$.retweeted_status.retweet_count"
PASSED_ON, LINK = "RT ", r"http\S+"


def followers_and_retweets(df: DataFrame, column: str = "value") -> DataFrame:
    """df with followers and retweets of JSON messages, 0 where a message doesn't have them."""
    number = lambda path: F.coalesce(F.get_json_object(column, path).try_cast("long"), F.lit(0))
    return df.withColumns({"followers": number(FOLLOWERS), "retweets": number(RETWEETS)})


def clean_message(text: Column) -> Column:
    """A message's text without line feeds, the mark of one that is passed on, and links."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\n", " "), PASSED_ON, ""), LINK, ""))


def judged_messages(df: DataFrame, good: Sequence[str], bad: Sequence[str], column: str = "value", text: str = "$.text") -> DataFrame:
    """seq, text, score, followers and retweets of JSON messages: the zip of what each branch says of a message."""
    words = clean_message(F.get_json_object(column, text))
    out = followers_and_retweets(df, column).withColumn("text", words)
    return out.select("seq", "text", word_score(F.col("text"), good, bad).alias("score"), "followers", "retweets")
