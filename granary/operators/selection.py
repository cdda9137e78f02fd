"""Choosing one representation for each object of an instance when representations share components.

Cost is what is read for the chosen ones and the size of the distinct components that they need. Instances are small and run
apart, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("independent", "marginal", "refine", "beam", "exact")
#: Plans by whole groups: one scheme for all, by exclusive bytes, and the better of two such by their exact cost.
GROUP_POLICIES = ("pure", "exclusive", "best_of_two")
#: Partial plans that the beam keeps.
BEAM = 16
#: Choices that the exact plan walks at most.
MOST_STATES = 200_000


class Instance:
    """Objects in order, each with schemes (name, read, {component: size})."""

    def __init__(self, objects: list[list[tuple[str, int, dict[str, int]]]]):
        self.objects = objects

    def cost(self, pick: list[int]) -> int:
        parts: dict[str, int] = {}
        read = 0
        for schemes, i in zip(self.objects, pick, strict=False):
            read += schemes[i][1]
            parts |= schemes[i][2]
        return read + sum(parts.values())

    def independent(self) -> list[int]:
        return [min(range(len(s)), key=lambda i: (s[i][1] + sum(s[i][2].values()), i)) for s in self.objects]

    def marginal(self) -> list[int]:
        have: set[str] = set()
        pick = []
        for s in self.objects:
            best = min(range(len(s)), key=lambda i: (s[i][1] + sum(n for c, n in s[i][2].items() if c not in have), i))
            have |= s[best][2].keys()
            pick.append(best)
        return pick

    def _kinds(self) -> list[str]:
        """Schemes besides each object's first, which is what it has anyway."""
        return sorted({s[0] for schemes in self.objects for s in schemes[1:]})

    def of_kind(self, kind: str) -> list[int]:
        """One scheme where an object has it; objects go back to their first, in order, where that costs the group no more."""
        pick = [next((i for i, s in enumerate(schemes) if s[0] == kind), 0) for schemes in self.objects]
        for o, i in enumerate(pick):
            if i and self.cost([*pick[:o], 0, *pick[o + 1 :]]) <= self.cost(pick):
                pick[o] = 0
        return pick

    def pure(self) -> list[int]:
        """The cheapest of the plans of one scheme, or everything as it is."""
        return min([[0] * len(self.objects), *map(self.of_kind, self._kinds())], key=self.cost)

    def best_of_two(self) -> list[int]:
        """The cheaper of the first two schemes' plans, or everything as it is, by the exact cost of the group."""
        return min([[0] * len(self.objects), *map(self.of_kind, self._kinds()[:2])], key=self.cost)

    def exclusive(self) -> list[int]:
        """One scheme for all its members if it saves by a rule that sees only bytes that one object holds alone.

        The rule takes from a member's gain what others share with it, so its plan may cost more than the start; the plan's cost
        is the exact one.
        """
        held: dict[str, int] = {}
        for schemes in self.objects:
            for c in schemes[0][2]:
                held[c] = held.get(c, 0) + 1
        best, pick = 0, [0] * len(self.objects)
        for kind in self._kinds():
            plan = [next((i for i, s in enumerate(schemes) if s[0] == kind), 0) for schemes in self.objects]
            members = [schemes for schemes, i in zip(self.objects, plan, strict=True) if i]
            freed = sum(n for schemes in members for c, n in schemes[0][2].items() if held[c] == 1)
            parts = {c: n for schemes, i in zip(self.objects, plan, strict=True) if i for c, n in schemes[i][2].items()}
            gain = freed - sum(parts.values())
            if gain > best:
                best, pick = gain, plan
        return pick

    def refine(self) -> list[int]:
        """Single swaps from the marginal plan while any lowers the cost."""
        pick = self.marginal()
        cost = self.cost(pick)
        while True:
            swaps = [(self.cost([*pick[:o], i, *pick[o + 1 :]]), o, i) for o, s in enumerate(self.objects) for i in range(len(s)) if i != pick[o]]
            best = min(swaps, default=(cost, 0, 0))
            if best[0] >= cost:
                return pick
            cost = best[0]
            pick[best[1]] = best[2]

    def beam(self, width: int = BEAM) -> list[int]:
        """The cheapest partial plans, object by object; no worse than the refined plan."""
        states: list[tuple[int, list[int], frozenset]] = [(0, [], frozenset())]
        for s in self.objects:
            grown = [(cost + read + sum(n for c, n in parts.items() if c not in have), [*pick, i], have | parts.keys()) for cost, pick, have in states for i, (_, read, parts) in enumerate(s)]
            states = sorted(grown, key=lambda x: (x[0], x[1]))[:width]
        return min([states[0][1], self.refine()], key=self.cost)

    def exact(self) -> list[int]:
        """Branch and bound; a bound on the rest is each object's least reading, for its components may all be shared."""
        best = self.refine()
        bound = self.cost(best)
        rest = [0] * (len(self.objects) + 1)
        for o in range(len(self.objects) - 1, -1, -1):
            rest[o] = rest[o + 1] + min(s[1] for s in self.objects[o])
        stack: list[tuple[list[int], int, frozenset]] = [([], 0, frozenset())]
        states = 0
        while stack:
            pick, cost, have = stack.pop()
            states += 1
            if states > MOST_STATES:
                raise ValueError("more choices than the exact plan walks")
            if cost + rest[len(pick)] >= bound:
                continue
            if len(pick) == len(self.objects):
                best, bound = pick, cost
                continue
            for i, (_, read, parts) in enumerate(self.objects[len(pick)]):
                stack.append(([*pick, i], cost + read + sum(n for c, n in parts.items() if c not in have), have | parts.keys()))
        return best


def planned(candidates: DataFrame, policies: tuple[str, ...] = POLICIES) -> DataFrame:
    """(inst, policy, cost, schemes) of candidates (inst, obj, scheme, read, components array<struct<id, size>>)."""
    names = ["inst", "policy", "cost", "schemes"]
    dealt = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "inst")
    held = dealt.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("obj", "scheme", "read", "components"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for inst, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                objects: dict[object, list] = {}
                for c in found:
                    objects.setdefault(c["obj"], []).append((c["scheme"], c["read"], {p["id"]: p["size"] for p in c["components"]}))
                case = Instance(list(objects.values()))
                for p in policies:
                    pick = getattr(case, p)()
                    rows.append((inst, p, case.cost(pick), [s[i][0] for s, i in zip(case.objects, pick, strict=True)]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], names=names)

    return held.mapInArrow(run, "inst string, policy string, cost bigint, schemes array<string>")
