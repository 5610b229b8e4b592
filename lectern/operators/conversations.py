"""Sessions and messages: history windows, ownership, access, append-only changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import is_follow_up, rewrite_question
from ..functions.text import email, session_title, strip
from ..functions.unicode import follow_up_udf


def with_history(messages: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Adds follow_up, last_user (last standalone question before) and last_assistant (last answer before)."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("follow_up", is_follow_up(follow_up_udf(F.col(text))))
    standalone = F.when((F.col(role) == "user") & ~F.col("follow_up"), F.col(text))
    answer = F.when(F.col(role) == "assistant", F.col(text))
    return rows.withColumn("last_user", F.last(standalone, True).over(w)).withColumn("last_assistant", F.last(answer, True).over(w))


def rewritten_questions(messages: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """User messages with the question that retrieval should see."""
    rows = with_history(messages, session, order, role, text).where(F.col(role) == "user")
    return rows.withColumn("rewritten", rewrite_question(F.col(text), F.col("follow_up"), F.col("last_user"), F.col("last_assistant")))


def owned_by(user: Column, asked: Column) -> Column:
    """Null-aware: anonymous users see sessions without an owner."""
    return user.eqNullSafe(asked)


def access(session_id: Column, owner: Column, user: Column) -> Column:
    """not_found, forbidden, claimed (ownerless, asked by a user) or granted."""
    return (
        F.when(session_id.isNull(), "not_found")
        .when(owner.isNull() & user.isNotNull(), "claimed")
        .when(~owner.eqNullSafe(user), "forbidden")
        .otherwise("granted")
    )


def claim(sessions: DataFrame, session_id, user_id) -> DataFrame:
    """Copy of `sessions` in which one ownerless session has an owner."""
    mine = (F.col("id") == session_id) & F.col("user_id").isNull()
    return sessions.withColumn("user_id", F.when(mine, F.lit(user_id)).otherwise(F.col("user_id")))


def create_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """`sessions` and the new ones (id, user_id, first message, created_at): their title is the message's beginning."""
    made = new.select("id", "user_id", session_title(F.col("first")).alias("title"), "created_at", F.col("created_at").alias("updated_at"))
    return sessions.unionByName(made.select(*sessions.columns))


def create_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """`users` and those of the new ones whose normalised address nobody has; of several with one address the first by id.

    Passwords come hashed: the engine neither sees nor stores them in the clear.
    """
    rows = new.withColumns({"email": email(F.col("email")), "full_name": strip(F.col("full_name"))})
    rows = rows.join(users.select("email"), "email", "left_anti")
    first = F.row_number().over(Window.partitionBy("email").orderBy("id"))
    rows = rows.withColumn("_n", first).where("_n = 1").withColumn("is_active", F.lit(True))
    return users.unionByName(rows.select(*users.columns))


def session_by_id(sessions: DataFrame, session_id) -> DataFrame:
    return sessions.where(F.col("id") == F.lit(session_id))


def session_for_user(sessions: DataFrame, session_id, user_id) -> DataFrame:
    """A session if it is the user's own; an anonymous user's if it has no owner."""
    return session_by_id(sessions, session_id).where(owned_by(F.col("user_id"), F.lit(user_id)))


def user_by_email(users: DataFrame, address: str) -> DataFrame:
    """Addresses are compared in their normalised form, in which they are stored."""
    return users.where(F.col("email") == email(F.lit(address)))


def user_by_id(users: DataFrame, user_id) -> DataFrame:
    return users.where(F.col("id") == F.lit(user_id))


def users_by_age(users: DataFrame) -> DataFrame:
    return users.orderBy("created_at", "id")


def append_message(messages: DataFrame, sessions: DataFrame, new: DataFrame) -> DataFrame:
    """`messages` and those of `new` whose session exists."""
    known = new.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return messages.unionByName(known.select(*messages.columns))


def recency(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with updated_at from their last message, newest first."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("_last"))
    rows = sessions.join(last, sessions["id"] == last["session_id"], "left").drop("session_id")
    return rows.withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last").orderBy(F.col("updated_at").desc(), "id")


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in `gone` (id) and their messages."""
    ids = gone.select("id")
    return sessions.join(ids, "id", "left_anti"), messages.join(ids, messages["session_id"] == ids["id"], "left_anti")
