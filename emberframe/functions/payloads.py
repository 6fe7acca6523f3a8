"""Alert messages as JSON text, keys in byte order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def webhook_payload(rule: Column, msg: Column, ts_seconds: Column) -> Column:
    return F.to_json(F.struct(msg.alias("msg"), rule.alias("rule"), ts_seconds.alias("ts")))


def chat_payload(msg: Column, username: str, icon_emoji: str, title: str = "alert") -> Column:
    return F.to_json(
        F.struct(
            F.lit(icon_emoji).alias("icon_emoji"),
            F.concat(F.lit(f"*{title}* — "), msg).alias("text"),
            F.lit(username).alias("username"),
        )
    )


def issue_payload(rule: Column, msg: Column, project: str, issue_type: str = "Task", title: str = "alert") -> Column:
    return F.to_json(
        F.struct(
            F.struct(
                msg.alias("description"),
                F.struct(F.lit(issue_type).alias("name")).alias("issuetype"),
                F.struct(F.lit(project).alias("key")).alias("project"),
                F.concat(F.lit(f"{title} – "), rule).alias("summary"),
            ).alias("fields")
        )
    )
