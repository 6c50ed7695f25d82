"""Message queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import conversation
from cairn.plans.registry import Tables, query

M = "m AS (SELECT conv_id, turn, role, text, (floor((length(coalesce(role, '')) + length(coalesce(text, '')) + 10) / 4) + 8)::BIGINT AS n FROM conversations)"
LAST = f"{M}, l AS (SELECT *, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), max(turn) OVER (PARTITION BY conv_id)) AS last FROM m)"


@query(f"WITH {M} SELECT conv_id, turn, n AS tokens FROM m")
def message_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", conversation.tokens(F.col("role"), F.col("text")).alias("tokens"))


@query(f"WITH {LAST} SELECT conv_id, turn, role FROM l WHERE turn >= last")
def last_user_tail(t: Tables) -> DataFrame:
    return conversation.tail(t.conversations).select("conv_id", "turn", "role")


@query(f"""WITH {LAST}, s AS (SELECT *, turn >= last OR min((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS fixed FROM l),
b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS cnt, sum(CASE WHEN fixed THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS f,
 sum(CASE WHEN fixed THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS newer FROM s) SELECT conv_id, turn FROM b WHERE total <= 300 OR cnt <= 2 OR fixed OR f + newer <= 300""")
def compress_history(t: Tables) -> DataFrame:
    return conversation.compressed(t.conversations, 300).select("conv_id", "turn")


@query("""WITH k AS (SELECT * FROM conversations WHERE coalesce(text, '') <> '' OR role IN ('system', 'tool')), c AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role OR role = 'tool' THEN 1 ELSE 0 END AS c FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT conv_id, min(turn) AS turn, min(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run""")
def merge_same_role(t: Tables) -> DataFrame:
    return conversation.merged_roles(t.conversations)


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def history_tail(t: Tables) -> DataFrame:
    return conversation.last_turns(t.conversations, 2).select("conv_id", "turn")


@query("SELECT conv_id, turn, regexp_replace('<think>' || role || chr(10) || '</think>' || text, '(?is)<think>.*?</think>', '', 'g') AS text FROM conversations")
def strip_think(t: Tables) -> DataFrame:
    from cairn.functions.text import strip_think as strip

    return t.conversations.select("conv_id", "turn", strip(F.concat(F.lit("<think>"), "role", F.lit("\n</think>"), "text")).alias("text"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '{conversation.REDACTED}' ELSE text END AS text FROM conversations")
def redact_history(t: Tables) -> DataFrame:
    m = t.conversations.withColumn("role", F.when(F.col("turn") % 3 == 1, "tool").otherwise(F.col("role"))).withColumn("name", F.lit("knowledge_search"))
    return conversation.redacted(m).select("conv_id", "turn", "text")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'tool' ELSE 'assistant' END AS role, text, CASE WHEN turn % 2 = 1 THEN 'c' || (turn % 4) END AS call_id, CASE WHEN turn % 2 = 0 THEN 'c' || ((turn + 1) % 6) END AS call FROM conversations),
f AS (SELECT conv_id, call, min(turn) AS t FROM m WHERE role = 'assistant' GROUP BY ALL)
SELECT m.conv_id, m.turn, CASE WHEN role = 'tool' AND (t IS NULL OR t >= turn) THEN 'system' ELSE role END AS role, CASE WHEN role = 'tool' AND (t IS NULL OR t >= turn) THEN '[Tool result for grep]: ' || text ELSE text END AS text FROM m LEFT JOIN f ON f.conv_id = m.conv_id AND f.call = m.call_id""")
def orphan_tools(t: Tables) -> DataFrame:
    odd = F.col("turn") % 2 == 1
    m = t.conversations.select("conv_id", "turn", F.when(odd, "tool").otherwise("assistant").alias("role"), "text", F.lit("grep").alias("name"), F.when(odd, F.concat(F.lit("c"), (F.col("turn") % 4).cast("string"))).alias("call_id"), F.when(~odd, F.array(F.concat(F.lit("c"), ((F.col("turn") + 1) % 6).cast("string")))).alias("calls"))
    return conversation.with_orphans_as_system(m).select("conv_id", "turn", "role", "text")
