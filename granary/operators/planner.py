"""Sequential policies, independent and marginal plans, tuning. A case is one group and as large as one lineage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import itemgetter, or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the policies.
PREMIUM, LATE_PREMIUM, LATE_OVERLAP = 1.10, 1.25, 0.25
HINTED, UNHINTED, REUSE, PLAIN_OVERLAP = 0.65, 0.25, 0.50, 0.10
LOOKAHEAD = {"one-step": (1, 64), "beam": (2, 8)}
OBJECT_OVERHEAD = 96
PLAIN = "plain"
#: States of a stage that the exact plan holds at most.
MOST_STATES = 100_000


def _overlap(a: list, b: list) -> float:
    if not a or not b:
        return 0.0
    held = set(a)
    return len([x for x in b if x in held]) / len(b)


class Stage(NamedTuple):
    """What policies see at a stage, whatever was admitted before: the plain candidate's place, how far each candidate's sample is like its scheme's last one (None: there is none), and each one's bytes to come next to the plain one's."""

    at: int
    plain: int
    alike: list[float | None]
    ahead: list[float]


def _greedy(s: Stage, cost: list[int]) -> int:
    return min(range(len(cost)), key=lambda i: (cost[i], i != s.plain, i))


def _premium(s: Stage, cost: list[int]) -> int:
    most = PREMIUM * cost[s.plain]
    near = [(c, i) for i, c in enumerate(cost) if i != s.plain and c <= most]
    return min(near)[1] if near else _greedy(s, cost)


def _late(s: Stage, cost: list[int]) -> int:
    if s.at:
        most = LATE_PREMIUM * cost[s.plain]
        for i, c in enumerate(cost):
            if i != s.plain and (s.alike[i] or 0.0) >= LATE_OVERLAP and c <= most:
                return i
    return _greedy(s, cost)


def _expected(s: Stage, cost: list[int]) -> int:
    return min(range(len(cost)), key=lambda i: (cost[i] + s.ahead[i], i != s.plain, i))


#: Policy -> place of the candidate admitted at a stage of these costs.
PICKS: dict[str, Callable[[Stage, list[int]], int]] = {"greedy": _greedy, "premium-cap": _premium, "late-bootstrap": _late, "expected-value": _expected}

#: Objects as bits of a number, by what each weighs.
Weights = list[tuple[float, int]]
Moves = tuple[list[int], list[tuple[int, int]]]


def _weigh(weights: Weights, left: int) -> float:
    return sum([w * (m & left).bit_count() for w, m in weights])


def _by_weight(pairs: Iterable[tuple[float, int]]) -> Weights:
    out: dict = {}
    for w, bit in pairs:
        out[w] = out.get(w, 0) | bit
    return list(out.items())


class Case:
    """Stages of one lineage: each a list of candidates (name, {object: size}, sample)."""

    def __init__(self, stages: list[list[tuple[str, dict, list]]], hinted: bool):
        self.stages, self.hinted = stages, hinted
        bits: dict = {}
        #: Of each stage's candidates: objects as bits, by what they weigh with their records.
        self.weights: list[list[Weights]] = []
        for stage in stages:
            here = []
            for _, objects, _ in stage:
                by: dict[int, int] = {}
                for o, n in objects.items():
                    if o not in bits:
                        bits[o] = 1 << len(bits)
                    by[n + OBJECT_OVERHEAD] = by.get(n + OBJECT_OVERHEAD, 0) | bits[o]
                here.append(list(by.items()))
            self.weights.append(here)
        self.masks = [[sum([m for _, m in w]) for w in stage] for stage in self.weights]
        self.bits = bits
        #: Of each stage the objects that its candidates need, and by those of them that are there what :meth:`moves` found.
        self.known: list[tuple[int, dict[int, Moves]]] = [(reduce(or_, masks), {}) for masks in self.masks]
        self.seen = []
        samples: dict[str, list] = {}
        for at, stage in enumerate(stages):
            plain = next(i for i, c in enumerate(stage) if c[0] == PLAIN)
            alike = [_overlap(samples[name], sample) if samples.get(name) else None for name, _, sample in stage]
            come = [_weigh(w, -1) * (1 - (x if x is not None else PLAIN_OVERLAP if i == plain else REUSE)) for i, (w, x) in enumerate(zip(self.weights[at], alike, strict=True))]
            again = HINTED if at and hinted else UNHINTED
            self.seen.append(Stage(at, plain, alike, [again * (x - come[plain]) for x in come]))
            samples |= {name: sample[:64] for name, _, sample in stage}

    @staticmethod
    def cost(candidate: tuple[str, dict, list], have: frozenset) -> int:
        return sum(n + OBJECT_OVERHEAD for o, n in candidate[1].items() if o not in have)

    def moves(self, at: int, have: int) -> Moves:
        """What each candidate of a stage adds to the objects there are, alone and with its objects; policies often meet in the same ones."""
        needs, known = self.known[at]
        have &= needs
        found = known.get(have)
        if found is None:
            left = ~have
            costs = [sum([w * (m & left).bit_count() for w, m in weights]) for weights in self.weights[at]]
            found = known[have] = costs, list(zip(costs, self.masks[at], strict=True))
        return found

    def ahead(self, at: int, depth: int, width: int, have: int) -> int:
        """The candidate that the cheapest plan over this stage and ``depth`` more begins with; after each the cheapest ``width`` go on, earlier ones first."""
        end = min(at + depth + 1, len(self.stages))
        states = [(c, have | m, i) for i, (c, m) in enumerate(self.moves(at, have)[1])]
        for k in range(at + 1, end):
            if len(states) > 1:
                states = sorted(states, key=itemgetter(0))[:width]
            needs, known = self.known[k]
            states = [(spent + c, held | m, first) for spent, held, first in states for c, m in (known.get(held & needs) or self.moves(k, held))[1]]
        return min(states, key=itemgetter(0))[2]

    def best(self) -> tuple[int, ...]:
        """The cheapest plan over all choices, of equal ones that of the earliest candidates."""
        closed = self._closed()
        return self._searched() if closed is None else closed

    def _closed(self) -> tuple[int, ...] | None:
        """The cheapest plan as a minimum cut, where each stage has its own copy first and at most one other candidate; else None.

        Taking the other candidate saves the own copy and needs its objects, which cost once. The least set of stages that
        saves most is what the source still reaches under a maximum flow from stages to their objects.
        """
        if any(len(stage) > 2 for stage in self.stages):
            return None
        own = size = 0
        weight: dict[float, int] = {}
        for weights, masks in zip(self.weights, self.masks, strict=True):
            if masks[0] & own:
                return None
            own |= masks[0]
            for w, m in weights[1] if len(weights) > 1 else ():
                weight[w] = weight.get(w, 0) | m
                size |= m
        if own & size or sum(m.bit_count() for m in weight.values()) != size.bit_count() or min([0, *weight, *(w for x in self.weights for w, _ in x[0])]) < 0:
            return None  # an object of the own copies that others use, one of several sizes, or sizes below none
        weights = list(weight.items())
        saved = [_weigh(x[0], -1) for x in self.weights]
        taken = have = 0
        open_ = [k for k, x in enumerate(self.masks) if len(x) > 1]
        more = True
        while more:  # most stages are settled alone
            more, left = False, ~have
            once = twice = 0
            for k in open_:
                m = self.masks[k][1]
                twice |= once & m
                once |= m
            rest = []
            for k in open_:
                m = self.masks[k][1]
                if saved[k] > _weigh(weights, m & ~have):
                    taken, have, more = taken | 1 << k, have | m, True
                elif saved[k] <= _weigh(weights, m & left & ~twice):
                    more = True
                else:
                    rest.append(k)
            open_ = rest
        for k in self._flow(open_, saved, weights, ~have) if open_ else ():
            taken |= 1 << k
        return tuple(taken >> k & 1 for k in range(len(self.stages)))

    def _flow(self, stages: list[int], saved: list[int], weights: Weights, left: int) -> set[int]:
        """Stages that the source reaches under a maximum flow from them to their objects that are left."""
        room: dict[int, float] = {}
        needs: dict[int, list[int]] = {}
        for k in stages:
            needs[k] = []
            for w, m in weights:
                m &= self.masks[k][1] & left
                while m:
                    bit = m & -m
                    m ^= bit
                    needs[k].append(bit)
                    room[bit] = w
        flow: dict[int, dict[int, float]] = {o: {} for o in room}
        over: list[int] = []
        for k in stages:
            push = saved[k]
            while push:
                came: dict[int, tuple[int, int] | None] = {k: None}
                queue, end = [k], 0
                for u in queue:
                    for o in needs[u]:
                        if room[o]:
                            end = o
                            break
                        for v, f in flow[o].items():
                            if f and v not in came:
                                came[v] = (u, o)
                                queue.append(v)
                    if end:
                        break
                if not end:
                    over.append(k)
                    break
                n, x = min(push, room[end]), u
                while came[x] is not None:
                    up, o = came[x]
                    n, x = min(n, flow[o][x]), up
                room[end] -= n
                flow[end][u] = flow[end].get(u, 0) + n
                while came[u] is not None:
                    up, o = came[u]
                    flow[o][u] -= n
                    flow[o][up] = flow[o].get(up, 0) + n
                    u = up
                push -= n
        reached = set(over)
        for u in over:  # grows
            for o in needs[u]:
                for v, f in flow[o].items():
                    if f and v not in reached:
                        reached.add(v)
                        over.append(v)
        return reached

    def _searched(self) -> tuple[int, ...]:
        """The cheapest plan forward over all stages; refuses to guess beyond its bound of states.

        Plans meet in a state, the objects admitted that later stages may use; of those that meet the cheapest goes on, unless
        it can't end at what the best policy costs.
        """
        most = min(sum(cost for _, cost in self.run(p)) for p in (*PICKS, *LOOKAHEAD))
        most += 1e-6 + 1e-9 * abs(most)
        used = [0]
        for masks in reversed(self.masks):
            used.insert(0, reduce(or_, masks, used[0]))
        states: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
        for k in range(len(self.stages)):
            shares = self._shares(k + 1)
            grown: dict[int, tuple[int, tuple[int, ...]]] = {}
            for held, (spent, path) in states.items():
                for i, (c, m) in enumerate(self.moves(k, held)[1]):
                    then, new = (held | m) & used[k + 1], (spent + c, (*path, i))
                    if then not in grown or new < grown[then]:
                        if new[0] + sum(min(_weigh(w, ~then) for w in stage) for stage in shares) <= most:
                            grown[then] = new
            if len(grown) > MOST_STATES:
                raise ValueError("more states than the exact plan allows")
            states = grown
        return states[0][1]

    def _shares(self, at: int) -> list[list[Weights]]:
        """No plan from a stage on costs less than its candidates of these weights: an object's cost is shared out over all stages that may still use it."""
        size: dict = {}
        uses: dict = {}
        for stage in self.stages[at:]:
            for o in set().union(*(c[1] for c in stage)):
                size[o] = min([size.get(o, math.inf), *(c[1][o] for c in stage if o in c[1])])
                uses[o] = uses.get(o, 0) + 1
        return [[_by_weight(((size[o] + OBJECT_OVERHEAD) / uses[o], self.bits[o]) for o in c[1]) for c in stage] for stage in self.stages[at:]]

    def run(self, policy: str) -> list[tuple[str, int]]:
        """(chosen, cost) by stage."""
        have = 0
        out = []
        plan = self.best() if policy == "oracle" else None
        for at, stage in enumerate(self.stages):
            cost = self.moves(at, have)[0]
            if plan is not None:
                pick = plan[at]
            elif policy in LOOKAHEAD:
                pick = self.ahead(at, *LOOKAHEAD[policy], have)
            else:
                pick = PICKS[policy](self.seen[at], cost)
            out.append((stage[pick][0], cost[pick]))
            have |= self.masks[at][pick]
        return out


POLICIES = ("greedy", "premium-cap", "late-bootstrap", "expected-value", "one-step", "beam", "oracle")
#: Cases that are read and planned at once.
CASES_AT_ONCE = 200


def _cases(b: pa.RecordBatch) -> Iterator[Case]:
    """The cases of a batch (case, hinted, all), read by column."""

    def lists(x: pa.Array) -> tuple[list[int], pa.Array]:
        return [0, *x.value_lengths().to_numpy().cumsum().tolist()], x.flatten()

    ends, found = lists(b.column(2))
    stage, name = (found.field(c).to_pylist() for c in ("stage", "name"))
    held, objects = lists(found.field("objects"))
    ids, sizes = (objects.field(c).to_pylist() for c in ("id", "size"))
    samples, sample = lists(found.field("sample"))
    sample = sample.to_pylist()
    for hinted, begin, end in zip(b.column(1).to_pylist(), ends, ends[1:], strict=False):
        stages: dict[int, list] = {}
        for i in range(begin, end):
            u, v = held[i], held[i + 1]
            stages.setdefault(stage[i], []).append((name[i], dict(zip(ids[u:v], sizes[u:v], strict=True)), sample[samples[i] : samples[i + 1]]))
        yield Case(list(stages.values()), bool(hinted))


def admission(candidates: DataFrame, policies: tuple[str, ...] = POLICIES, dealt: bool = False) -> DataFrame:
    """(case, policy, stage, chosen, cost) of candidates (case, hinted, stage, rank, name, objects array<struct<id, size>>, sample array<string>).

    A stage sees what earlier stages admitted, so a case is sequential; cases run apart, a row each. ``dealt``: candidates are
    in a fixed number of partitions by case already.
    """

    # cases are few bytes and much work: their number of partitions is fixed, so that it isn't coalesced by size
    if not dealt:
        candidates = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case")
    held = candidates.groupBy("case").agg(F.max("hinted").alias("hinted"), F.array_sort(F.collect_list(F.struct("stage", "rank", "name", "objects", "sample"))).alias("all"))
    names = ["case", "policy", "stage", "chosen", "cost"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CASES_AT_ONCE):
                b = whole.slice(at, CASES_AT_ONCE)
                size: list[int] = []
                out: list[tuple[str, int]] = []
                for case in _cases(b):
                    size.append(len(case.stages))
                    for p in policies:
                        out += case.run(p)
                n = np.repeat(size, len(policies))  # rows of each case and policy
                begin = np.repeat(np.cumsum(n) - n, n)
                cols = (
                    b.column(0).take(pa.array(np.repeat(np.arange(len(size)), np.array(size) * len(policies)))),
                    pa.array(policies, pa.string()).take(pa.array(np.repeat(np.tile(np.arange(len(policies)), len(size)), n))),
                    pa.array(np.arange(len(out)) - begin, pa.int32()),
                    pa.array([x for x, _ in out], pa.string()),
                    pa.array([x for _, x in out], pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(list(cols), names=names)

    return held.mapInArrow(fold, "case string, policy string, stage int, chosen string, cost bigint")


def independent(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """(obj, scheme, cost): the cheapest scheme of each object against what is stored, others unseen; of (obj, scheme, read, component, size)."""
    price = candidates.join(stored.select("component", F.lit(True).alias("have")), "component", "left")
    per = price.groupBy("obj", "scheme").agg((F.max("read") + F.coalesce(F.sum(F.when(F.col("have").isNull(), F.col("size"))), F.lit(0))).alias("cost"))
    w = Window.partitionBy("obj").orderBy("cost", "scheme")
    return per.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def leave_one_fold_out(results: DataFrame) -> DataFrame:
    """(fold, setting, cost): the setting that is best on all other folds, and its mean on this one; of (fold, setting, cost)."""
    per = results.groupBy("fold", "setting").agg(F.sum("cost").alias("s"), F.count("*").alias("n"))
    all_ = per.groupBy("setting").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = per.join(all_, "setting").withColumn("other", F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")))
    w = Window.partitionBy("fold").orderBy("other", "setting")
    return rest.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("fold", "setting", (F.col("s") / F.col("n")).alias("cost"))


def releasable(holdings: DataFrame, overhead: int = OBJECT_OVERHEAD) -> DataFrame:
    """(obj, bytes): components that only this object holds, with their records; of (obj, component, size)."""
    one = holdings.groupBy("component").agg(F.count("*").alias("n"), F.min("obj").alias("obj"), F.max("size").alias("size")).filter("n = 1")
    return one.groupBy("obj").agg(F.sum(F.col("size") + overhead).alias("bytes"))


def marginal(wanted: DataFrame, stored: DataFrame, overhead: int = OBJECT_OVERHEAD) -> DataFrame:
    """(obj, bytes): what admitting each object alone would add."""
    return wanted.select("obj", "component", "size").distinct().join(stored.select("component"), "component", "left_anti").groupBy("obj").agg(F.sum(F.col("size") + overhead).alias("bytes"))


def what_if(holdings: DataFrame, moves: DataFrame, overhead: int = OBJECT_OVERHEAD) -> DataFrame:
    """One row (live_delta, peak_extra) if objects were held by other components: of both sides (obj, component, size).

    New components are written before old ones go: the peak is what of them isn't there yet. The store isn't changed.
    """
    kept = holdings.join(moves.select("obj").distinct(), "obj", "left_anti")
    sized = lambda d, name: d.groupBy("component").agg((F.max("size") + overhead).alias(name))
    j = sized(holdings, "now").join(sized(kept.unionByName(moves.select("obj", "component", "size")), "then"), "component", "full_outer")
    now, then = F.coalesce("now", F.lit(0)), F.coalesce("then", F.lit(0))
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return j.agg(total(then - now, "live_delta"), total(F.when(F.col("now").isNull(), then), "peak_extra"))


#: Outcomes of deferred work.
TICK, FORCED, WAITING = "tick", "forced", "waiting"


def deferred(arrivals: DataFrame, room: int, every: int, budget: int) -> DataFrame:
    """(key, content, first, arrivals, how, at): units of work of arrivals (key, seq, content) through a bounded queue for each key.

    Arrivals of content that waits already join its unit. A full queue does its oldest unit at once to make room. After every
    ``every`` arrivals a tick does up to ``budget`` of the oldest; it yields after that, and the rest wait on. ``at`` is the
    arrival that a unit was done after, null for those that wait at the end.
    """
    kind = arrivals.schema["key"].dataType.simpleString()
    held = arrivals.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("a"))
    names = ["key", "content", "first", "arrivals", "how", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                queue: dict[str, list[int]] = {}

                def done(how: str, at: int | None, key=key, queue=queue) -> None:
                    content = next(iter(queue))
                    seqs = queue.pop(content)
                    rows.append((key, content, seqs[0], len(seqs), how, at))

                for n, x in enumerate(found, 1):
                    if x["content"] not in queue and len(queue) == room:
                        done(FORCED, x["seq"])
                    queue.setdefault(x["content"], []).append(x["seq"])
                    if n % every == 0:
                        for _ in range(min(budget, len(queue))):
                            done(TICK, x["seq"])
                while queue:
                    done(WAITING, None)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return held.mapInArrow(run, f"key {kind}, content string, first bigint, arrivals bigint, how string, at bigint")


def churn(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, reason) of entries (id, base, offset, payload, raw) of two packs: new, gone, same, moved, repacked, changed."""
    l, r = a.select("id", *[F.col(c).alias(f"l_{c}") for c in ("base", "offset", "payload", "raw")]), b.select("id", *[F.col(c).alias(f"r_{c}") for c in ("base", "offset", "payload", "raw")])
    same = lambda c: F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    j = l.withColumn("in_l", F.lit(True)).join(r.withColumn("in_r", F.lit(True)), "id", "full_outer")
    reason = (
        F.when(F.col("in_l").isNull(), "new")
        .when(F.col("in_r").isNull(), "gone")
        .when(same("base") & same("payload") & same("offset"), "same")
        .when(same("base") & same("payload"), "moved")
        .when(same("base") & same("raw"), "repacked")
        .otherwise("changed")
    )
    return j.select("id", reason.alias("reason"))


def priors(stages: DataFrame, default_ratio: float = 1.0) -> DataFrame:
    """One row pooled over lineages: ratio, rho_rep, rho_plain, q, n; of stages (lineage, t, scheme, own, overlap), overlap null at t = 0.

    ratio is the geometric mean of a scheme's bytes over the plain copy's at the same stage; rho the mean overlap with the
    stage before; q how often another stage follows, held within 0.05 and 0.95. Give it training lineages only.
    """
    plain = stages.filter(F.col("scheme") == PLAIN).select("lineage", "t", F.col("own").alias("plain_own"))
    j = stages.join(plain, ["lineage", "t"], "left")
    other = F.col("scheme") != PLAIN
    part = j.agg(
        F.coalesce(F.exp(F.avg(F.when(other & (F.col("own") > 0) & (F.col("plain_own") > 0), F.log(F.col("own") / F.col("plain_own"))))), F.lit(default_ratio)).alias("ratio"),
        F.avg(F.when(other & (F.col("t") > 0), F.col("overlap"))).alias("rho_rep"),
        F.avg(F.when(~other & (F.col("t") > 0), F.col("overlap"))).alias("rho_plain"),
    )
    length = stages.groupBy("lineage").agg(F.count_distinct("t").alias("n")).agg(F.sum(F.col("n") - 1).alias("more"), F.sum("n").alias("all"), F.count("*").alias("n"))
    q = F.least(F.greatest(F.try_divide("more", "all"), F.lit(0.05)), F.lit(0.95))
    return part.withColumns({"q": length.select(q).scalar(), "n": length.select("n").scalar()})
