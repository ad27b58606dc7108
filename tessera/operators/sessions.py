"""Sessions, identity and audit: transcripts, context budgets, latest-wins sessions, tokens, lockouts."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, message_cost
from ..sources.shared import small, written

# Fixed value: what stands in for an answer without text.
NO_RESPONSE = "(표시할 응답이 없습니다. 안전 정책에 따라 답변이 거부되었을 수 있습니다.)"
MAX_ATTEMPTS, LOCKOUT_SECONDS = 5, 600
#: Attempts of a key that are one task's, about.
PIECE_ATTEMPTS = 100_000


def transcript(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): each user turn, and all assistant text after it as one row.

    Assistant text before the first user turn is a row of its own; a turn without text gets the
    notice; other roles are dropped. messages: conv_id, turn, role, text.
    """
    conv = Window.partitionBy("conv_id").orderBy("turn")
    said = messages.where("role IN ('user', 'assistant')").withColumn("island", F.sum((F.col("role") == "user").cast("int")).over(conv))
    users = said.where("role = 'user'").select("conv_id", (F.col("island") * 2 - 1).alias("seq"), "role", "text")
    answers = said.groupBy("conv_id", "island").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))).alias("x")
    )
    joined = F.array_join("x.text", "")
    text = F.when(F.regexp_replace(joined, r"(?U)\s", "") == "", NO_RESPONSE).otherwise(joined)
    return users.union(answers.where("island > 0 OR size(x) > 0").select("conv_id", F.col("island") * 2, F.lit("assistant"), text))


def merged_roles(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): neighbours of one role joined by a blank line; empty answers and other roles dropped."""
    conv = Window.partitionBy("conv_id").orderBy("turn")
    kept = messages.where("role = 'user' OR (role = 'assistant' AND text <> '')")
    turned = kept.withColumn("new", F.coalesce(F.lag("role").over(conv) != F.col("role"), F.lit(True)))
    run = turned.withColumn("seq", F.sum(F.col("new").cast("int")).over(conv))
    return run.groupBy("conv_id", "seq").agg(
        F.first("role").alias("role"), F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n\n").alias("text")
    )


def fitted_context(messages: DataFrame, budget: int | Column, used: int | Column = 0) -> DataFrame:
    """messages that fit: from the newest back until one does not, then from the first user turn on.

    Every message costs something, so the running cost decides alone.
    """
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cost = F.sum(message_cost(F.col("text"))).over(back)
    kept = messages.withColumn("running_cost", cost).where(F.col("running_cost") + used <= budget)
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return kept.withColumn("__first", first).where(F.col("turn") >= F.col("__first")).drop("__first")


def fitted_hits(requests: DataFrame, hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, n_hits, status, merged): how many of the ranked hits fit with the system text and the question.

    requests: query_id, base_cost (system and question) and, if there is one, pending_cost: what a
    question that was never answered adds when it goes before this one; it is merged if that
    fits too. hits: query_id, rank, cost. status is fitted, no_documents (nothing was found) or
    rejected (not even one hit, or the question, fits).
    """
    pending = F.col("pending_cost") if "pending_cost" in requests.columns else F.lit(None)
    asked = requests.select("query_id", "base_cost", pending.cast("long").alias("pending_cost"))
    running = hits.withColumn("sum", F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank")))
    fits = F.col("base_cost") + F.col("sum") <= budget
    found = asked.join(running, "query_id", "left").groupBy("query_id", "base_cost", "pending_cost").agg(
        F.count("rank").alias("found"), F.max(F.when(fits, F.struct("rank", "sum"))).alias("fit")
    )
    status = F.when((F.col("found") == 0) & (F.col("base_cost") <= budget), "no_documents").when(F.col("fit").isNotNull(), "fitted").otherwise("rejected")
    used = F.col("base_cost") + F.coalesce("fit.sum", F.lit(0))
    merged = (F.col("status") != "rejected") & F.coalesce(used + F.col("pending_cost") <= budget, F.lit(False))
    return found.withColumn("status", status).select("query_id", F.coalesce("fit.rank", F.lit(0)).cast("long").alias("n_hits"), "status", merged.alias("merged"))


def pending_question(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text): the last message of each conversation, where it is a user's and so was never answered."""
    last = messages.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("m"))
    return last.where("m.role = 'user'").select("conv_id", "m.turn", "m.text")


def session_list(sessions: DataFrame, limit: int = 50) -> DataFrame:
    w = Window.partitionBy("username").orderBy(F.desc("updated_at"), "session_id")
    return sessions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def upsert_sessions(current: DataFrame, changes: DataFrame, create: bool = True) -> DataFrame:
    """Sessions after changes (same columns): the latest updated_at wins, the first created_at stays.

    Without create, changes to sessions that do not exist (for that user) are dropped.
    """
    if not create:
        changes = changes.join(current.select("session_id", "username"), ["session_id", "username"], "left_semi")
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c not in ("session_id", "created_at")]
    latest = F.max_by(F.struct(*rest), F.struct("updated_at", "__new"))
    return both.groupBy("session_id").agg(latest.alias("s"), F.min("created_at").alias("created_at")).select(
        "session_id", *[F.col(f"s.{c}").alias(c) for c in rest], "created_at"
    ).select(*current.columns)


def resolve_tokens(tokens: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """(token_hash, username, role, clearance) of tokens that have not run out, of users who are not disabled."""
    live = tokens.where(F.col("expires_at") > F.lit(as_of)).select("token_hash", "username")
    return live.join(users.where("NOT disabled").select("username", "role", "clearance"), "username").select("token_hash", "username", "role", "clearance")


def purge_tokens(tokens: DataFrame, as_of, revoked_users: DataFrame | None = None) -> DataFrame:
    """tokens without those that have run out and those of revoked users (disabled, deleted or with a new password)."""
    kept = tokens.where(F.col("expires_at") > F.lit(as_of))
    return kept if revoked_users is None else kept.join(revoked_users.select("username"), "username", "left_anti")


def without_users(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """A table of tokens or sessions after users were deleted."""
    return table.join(deleted.select("username"), "username", "left_anti")


def updated_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """users with the given values of changes (username and any of its columns; null leaves a value alone)."""
    names = [c for c in changes.columns if c != "username"]
    c = changes.select("username", *[F.col(n).alias(f"__{n}") for n in names])
    return users.join(c, "username", "left").select(
        *[F.coalesce(f"__{n}", n).alias(n) if n in names else F.col(n) for n in users.columns]
    )


def user_list(users: DataFrame) -> DataFrame:
    return users.orderBy("username")


def user_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("n"))


def user_named(users: DataFrame, username: str) -> DataFrame:
    """The user of that name, or no row."""
    return users.where(F.col("username") == username)


def owned_session(sessions: DataFrame, session_id: str, username: str | None = None) -> DataFrame:
    found = sessions.where(F.col("session_id") == session_id)
    return found if username is None else found.where(F.col("username") == username)


def without_sessions(sessions: DataFrame, deletions: DataFrame) -> DataFrame:
    """sessions after deletions (session_id, username): by its owner where a username is given, by anyone where it is null."""
    by = F.col("by").isNull() | (F.col("by") == F.col("username"))
    d = deletions.select(F.col("session_id").alias("gone"), F.col("username").alias("by"))
    return sessions.join(d, (F.col("session_id") == F.col("gone")) & by, "left_anti")


def lockouts(
    attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, seconds: int = LOCKOUT_SECONDS, piece: int = PIECE_ATTEMPTS
) -> DataFrame:
    """attempts (client_key, attempt_id, ts, success) with locked and failures.

    An attempt is locked if max_attempts failures or more lie within `seconds` before it; locked
    attempts leave no trace; success forgets the failures. The attempts of a key pass through a
    task in order of time (then id): what is kept is the last max_attempts times. A key with more
    than `piece` attempts is cut into spans of time of about so many, each a task's. What a piece
    hands on is only known when what it was handed is, but pieces forget quickly (at a success, or
    a pause of `seconds`): all run from what is known so far, and those that were handed something
    else than they ran from run again, until none is.
    """
    key = attempts.schema["client_key"].dataType.simpleString()
    rows = attempts.select("client_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("attempt_id").cast("bigint").alias("attempt_id"), "success")
    fold = fold_of(max_attempts, seconds * 1_000_000)
    sizes = rows.groupBy(F.col("client_key").alias("hot_key")).agg(F.count("*").alias("n"), F.min("t").alias("begin"), F.max("t").alias("end"))
    hot = written(sizes.where(F.col("n") > piece), "hot")
    shape = f"client_key {key}, piece bigint, attempt_id bigint, locked boolean, failures int, after array<bigint>"
    nothing = F.array().cast("array<bigint>")

    def folded(pieces: DataFrame) -> DataFrame:
        """pieces (client_key, piece, t, attempt_id, success, before), folded; after: what a piece hands on, on its last row."""
        dealt = pieces.repartition("client_key", "piece").sortWithinPartitions("client_key", "piece", "t", "attempt_id")
        return dealt.select("client_key", "piece", "t", "attempt_id", "success", "before").mapInArrow(fold, shape)

    if hot.isEmpty():
        return folded(rows.withColumns({"piece": F.lit(0).cast("bigint"), "before": nothing})).drop("piece", "after")
    with_size = rows.join(small(hot, 64), F.col("client_key").eqNullSafe(F.col("hot_key")), "left")
    width = F.greatest(F.ceil((F.col("end") - F.col("begin") + 1) * (F.lit(float(piece)) / F.col("n"))), F.lit(1))
    cut = with_size.withColumn("piece", F.coalesce(F.floor((F.col("t") - F.col("begin")) / width), F.lit(0)).cast("bigint"))
    shown = ["client_key", "piece", "t", "attempt_id", "success"]
    cold = folded(cut.where("n IS NULL").select(*shown).withColumn("before", nothing)).drop("piece", "after")
    pieces = written(cut.where("n IS NOT NULL").select(*shown), "pieces")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # One row for each piece from here on: what it was handed, and what it handed on.
    state, kept, again = None, None, pieces.withColumn("before", nothing)
    while True:
        handed = folded(again).where("after IS NOT NULL").select("client_key", "piece", "after")
        handed = written(handed if kept is None else handed.unionByName(kept), "handed")
        before = F.coalesce(F.lag("after").over(Window.partitionBy("client_key").orderBy("piece")), nothing)
        new = handed.select(F.col("client_key").alias("k"), F.col("piece").alias("p"), "after", before.alias("before"))
        if state is None:
            state = written(new.withColumn("changed", F.size("before") > 0), "state")
        else:
            old = state.select(F.col("k").alias("ok"), F.col("p").alias("op"), F.col("before").alias("was"))
            state = written(new.join(old, same("k", "ok") & same("p", "op")).select("k", "p", "after", "before", (F.col("before") != F.col("was")).alias("changed")), "state")
        moved = state.where("changed")
        if moved.isEmpty():
            break
        again = pieces.join(small(moved.select("k", "p", "before"), 128), same("client_key", "k") & same("piece", "p")).drop("k", "p")
        kept = state.where("NOT changed").select(F.col("k").alias("client_key"), F.col("p").alias("piece"), "after")
    final = pieces.join(small(state.select("k", "p", "before"), 128), same("client_key", "k") & same("piece", "p")).drop("k", "p")
    return cold.unionByName(folded(final).drop("piece", "after"))


def fold_of(max_attempts: int, span: int):
    """For mapInArrow over (client_key, piece, t, attempt_id, success, before), pieces in order of time one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["client_key", "piece", "attempt_id", "locked", "failures", "after"]
        at, recent, held = None, [], None

        def told(b: pa.RecordBatch, locked: list, failures: list, after: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(3), pa.array(locked, pa.bool_()), pa.array(failures, pa.int32()), pa.array(after, pa.list_(pa.int64())),
            ], names)

        for b in batches:
            if not b.num_rows:
                continue
            locked, failures, after = [], [], []
            for k, p, t, success, before in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                if (k, p) != at:
                    # The row before was its piece's last.
                    if after:
                        after[-1] = recent
                    elif held is not None:
                        held[3][-1] = recent
                    at, recent = (k, p), before
                recent = [x for x in recent if t - x < span]
                locked.append(len(recent) >= max_attempts)
                failures.append(len(recent))
                after.append(None)
                if not locked[-1]:
                    recent = [] if success else [*recent, t]
            if held is not None:
                yield told(*held)
            held = (b, locked, failures, after)
        if held is not None:
            held[3][-1] = recent
            yield told(*held)

    return run


def recent_failures(attempts: DataFrame, seconds: int = LOCKOUT_SECONDS) -> DataFrame:
    """attempts with the number of failures of its key in the `seconds` before it (itself included): a range window."""
    w = Window.partitionBy("client_key").orderBy("t").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    d = attempts.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return d.withColumn("recent_failures", F.sum((~F.col("success")).cast("long")).over(w)).drop("t")


TOKEN_SUMS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def audit_sums() -> list[Column]:
    """Records, blocked rate, and token sums (cache reads and writes apart; unknown counts as nothing)."""
    return [
        F.count("*").alias("records"), F.round(F.avg((F.col("event") == "blocked").cast("int")), 6).alias("blocked_rate"),
        *[F.sum(c).alias(c) for c in TOKEN_SUMS],
    ]


def audit_rollup(audit: DataFrame, *by: str) -> DataFrame:
    """The sums of an audit trail for each group."""
    return audit.groupBy(*by).agg(*audit_sums())


#: The views of an audit trail: how many of (day, event), user and label are grouped by.
VIEWS = {"all": (), "day": ("day",), "day and event": ("day", "event"), "event": ("event",), "user": ("user_id",), "user and label": ("user_id", "classification"), "label": ("classification",)}


def audit_views(audit: DataFrame) -> DataFrame:
    """(view, day, event, user_id, classification, key, records, blocked_rate, token sums, times): an audit trail from all sides in one pass.

    One row for each group of each of VIEWS, told apart by grouping_id, so a null that is a value
    stays one; further, for each tool that was called (key) the records and how often (view tool),
    and for each label that was masked (key) the records and how often (view redaction). A record's
    day is that of its timestamp.
    """
    d = audit.withColumn("day", F.to_date("timestamp"))
    keys = ["day", "event", "user_id", "classification"]
    sets = [[F.col(k) for k in v] for v in VIEWS.values()]
    # grouping_id has a bit for each key, the first highest, that is 1 where the key is not grouped by.
    numbers = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in v): name for name, v in VIEWS.items()}
    of = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    # The event is grouped away in most views: what is counted of it is a column of its own.
    said = d.withColumn("was_blocked", (F.col("event") == "blocked").cast("int"))
    sums = [F.count("*").alias("records"), F.round(F.avg("was_blocked"), 6).alias("blocked_rate"), *[F.sum(c).alias(c) for c in TOKEN_SUMS]]
    views = said.groupingSets(sets, *keys).agg(F.grouping_id().cast("int").alias("g"), *sums)
    views = views.withColumn("view", of[F.col("g")]).drop("g").withColumns({"key": F.lit(None).cast("string"), "times": F.lit(None).cast("long")})
    tools = d.select(F.explode(F.map_entries(F.aggregate(
        F.coalesce("tools_called", F.array().cast("array<string>")), F.create_map().cast("map<string,long>"),
        lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != t), F.create_map(t, F.coalesce(F.try_element_at(m, t), F.lit(0).cast("long")) + 1)),
    ))).alias("e")).select(F.lit("tool").alias("view"), F.col("e.key").alias("key"), F.col("e.value").alias("n"))
    masked = d.select(F.explode("redactions").alias("key", "n")).select(F.lit("redaction").alias("view"), "key", F.col("n").cast("long").alias("n"))
    more = tools.unionByName(masked).groupBy("view", "key").agg(F.count("*").alias("records"), F.sum("n").alias("times"))
    return views.unionByName(more, allowMissingColumns=True).select("view", *keys, "key", "records", "blocked_rate", *TOKEN_SUMS, "times")


def tool_counts(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode("tools_called").alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


def last_audit(audit: DataFrame, limit: int, order: str = "timestamp", tie: str = "session_id") -> DataFrame:
    """The last `limit` records (held to 1 to 1000) in their order."""
    return audit.orderBy(F.desc(order), F.desc(tie)).limit(min(max(limit, 1), 1000)).orderBy(order, tie)


# How addresses are written.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
GROUP = "[0-9A-Fa-f]{1,4}"


def address_bits(address: Column) -> Column:
    """An address as v4 and 8, or v6 and 32 hexadecimal digits, which are in the order of addresses; null if it is none.

    A zone after % is left out. An IPv4 address that is written into IPv6 (::ffff:1.2.3.4) is one
    of IPv6: networks of either family hold only their own.
    """
    t = F.trim(address)
    hex_of = lambda x, n: F.lpad(F.lower(x), n, "0")

    def digits_of_v4(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, "[.]"), lambda o: hex_of(F.hex(o.try_cast("bigint")), 2)), "")

    v4 = F.when(t.rlike(f"^{IPV4}$"), F.concat(F.lit("v4"), digits_of_v4(t)))
    six = F.regexp_replace(t, "%[^/%]+$", "")
    tail = F.regexp_extract(six, f"(?<=:)({IPV4})$", 1)
    inner = digits_of_v4(tail)
    groups_only = F.when(tail == "", six).otherwise(F.concat(F.left(six, F.length(six) - F.length(tail)), F.left(inner, F.lit(4)), F.lit(":"), F.substring(inner, 5, 4)))
    sides = F.split(groups_only, "::", -1)
    parts = lambda x: F.filter(F.split(x, ":", -1), lambda g: g != "")
    before, after = parts(sides[0]), F.when(F.size(sides) == 2, parts(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    n = F.size(before) + F.size(after)
    whole = groups_only.rlike(f"^{GROUP}(?::{GROUP}){{7}}$")
    cut = (F.size(sides) == 2) & (n <= 7) & groups_only.rlike(f"^(?:{GROUP}(?::{GROUP})*)?::(?:{GROUP}(?::{GROUP})*)?$")
    filled = F.concat(before, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), after)
    v6 = F.when(whole | cut, F.concat(F.lit("v6"), F.array_join(F.transform(filled, lambda g: hex_of(g, 4)), "")))
    return F.coalesce(v4, v6)


def trusted_networks(names: Iterable[str]) -> tuple[list[tuple[str, str]], bool]:
    """(ranges, all): networks and addresses of either family as ranges of address_bits, merged and in order; all: whether `*` is among them.

    What cannot be read is left out, as are blanks.
    """
    found, every = [], False
    for name in (n.strip() for n in names):
        if name == "*":
            every = True
        elif name:
            try:
                net = ipaddress.ip_network(name, strict=False)
            except ValueError:
                continue
            digits = 8 if net.version == 4 else 32
            found.append((f"v{net.version}{int(net[0]):0{digits}x}", f"v{net.version}{int(net[-1]):0{digits}x}"))
    merged: list[tuple[str, str]] = []
    for lo, hi in sorted(found):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged, every


def client_address(peer: Column, forwarded: Column, trusted: Iterable[str | tuple[str, int]]) -> Column:
    """The right-most forwarded hop that is no trusted proxy; else the first hop; else the peer.

    trusted: networks of IPv4 or IPv6 (10.0.0.0/8, 2001:db8::/32, or (network, prefix length)),
    addresses, or `*` for any peer. Only a trusted peer's header is believed. Networks become
    disjoint ranges, and an address is looked up in their order by halving.
    """
    ranges, every = trusted_networks(n if isinstance(n, str) else f"{n[0]}/{n[1]}" for n in trusted)
    if not ranges and not every:
        return peer

    def within(bits: Column, some: list[tuple[str, str]]) -> Column:
        if len(some) <= 2:
            return reduce(lambda a, b: a | b, [bits.between(lo, hi) for lo, hi in some])
        half = len(some) // 2
        return F.when(bits < some[half][0], within(bits, some[:half])).otherwise(within(bits, some[half:]))

    def inside(a: Column) -> Column:
        return F.lit(True) if every else F.coalesce(let(address_bits(a), lambda bits: within(bits, ranges)), F.lit(False))

    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda h: F.trim(h)), lambda h: h != "")
    outside = F.filter(F.reverse(hops), lambda h: ~inside(h))
    return F.when(inside(peer), F.coalesce(F.get(outside, F.lit(0)), F.get(hops, F.lit(0)), peer)).otherwise(peer)
