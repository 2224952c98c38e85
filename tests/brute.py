"""Expressions worked out with sets and loops, for comparison."""

from decimal import Decimal

from conceptmill import catalog as fixed
from conceptmill.ecl import tree as t


class Brute:
    """``concept``: id -> (module, date, active, defined); ``isa``: (child, parent); ``rows``: (source, group, type, target);
    ``numbers``: (source, group, type, text); ``members``: (refset, date, active, module, member)."""

    def __init__(self, concept, isa, rows, numbers, members):
        self.concept, self.isa, self.rows, self.numbers, self.members = concept, isa, rows, numbers, members
        self.up = {c: {p for x, p in isa if x == c} for c in concept}
        self.above = {c: self.reach(c) for c in concept}

    def reach(self, c):
        seen, rest = set(), list(self.up[c])
        while rest:
            x = rest.pop()
            if x not in seen:
                seen.add(x)
                rest += self.up[x]
        return seen

    def of(self, n) -> set:
        if isinstance(n, t.Concept):
            return {n.id} & self.concept.keys()
        if isinstance(n, t.Any):
            return set(self.concept)
        if isinstance(n, t.And):
            return set.intersection(*map(self.of, n.parts))
        if isinstance(n, t.Or):
            return set.union(*map(self.of, n.parts))
        if isinstance(n, t.Minus):
            return self.of(n.left) - self.of(n.right)
        if isinstance(n, t.Hierarchy):
            return self.hierarchy(n.op, self.of(n.of))
        if isinstance(n, t.Members):
            return self.membership(n, self.of(n.of))
        if isinstance(n, t.Filtered):
            return {c for c in self.of(n.of) if all(self.metadata(c, f) for f in n.filters)}
        return {c for c in self.of(n.of) if self.satisfied(n.refinement, self.all_rows(c), self.all_numbers(c), c)}

    def hierarchy(self, op, inside):
        if op == "!!>":
            return {c for c in inside if not self.above[c] & inside}
        if op == "!!<":
            return {c for c in inside if not any(c in self.above[d] for d in inside)}
        near = self.up if "!" in op else self.above
        found = {c for c in self.concept if near[c] & inside} if op[0] == "<" else {p for c in inside for p in near[c]}
        return found | inside if op[:2] in ("<<", ">>") else found

    @staticmethod
    def dated(date, op, wanted):
        if op in ("=", "!="):
            return (date in wanted) == (op == "=")
        return date is not None and any({"<": date < w, "<=": date <= w, ">": date > w, ">=": date >= w}[op] for w in wanted)

    def metadata(self, c, f):
        module, date, active, defined = self.concept[c]
        if f.field == "active":
            return active == (f.value == (f.op == "="))
        if f.field == "definitionStatus":
            return defined == (f.op == "=")
        if f.field == "moduleId":
            return (module in self.of(f.value)) == (f.op == "=")
        return self.dated(date, f.op, f.value)

    def membership(self, n, inside):
        status = [f.value == (f.op == "=") for f in n.filters if f.field == "active"] or [True]
        rows = [m for m in self.members if m[2] == status[0] and m[4] in self.concept]
        for f in n.filters:
            if f.field == "moduleId":
                rows = [m for m in rows if (m[3] in self.of(f.value)) == (f.op == "=")]
            elif f.field == "effectiveTime":
                rows = [m for m in rows if self.dated(m[1], f.op, f.value)]
        if n.reverse:
            return {m[0] for m in rows if m[4] in inside} & self.concept.keys()
        return {m[4] for m in rows if m[0] in inside}

    def all_rows(self, c):
        return [r for r in self.rows if r[0] == c] + [(c, 0, fixed.IS_A, p) for p in self.up[c]]

    def all_numbers(self, c):
        return [r for r in self.numbers if r[0] == c]

    @staticmethod
    def within(n, node):
        return node.least <= n and (node.most is None or n <= node.most)

    def satisfied(self, n, rows, numbers, c):
        if isinstance(n, t.AllOf):
            return all(self.satisfied(p, rows, numbers, c) for p in n.parts)
        if isinstance(n, t.AnyOf):
            return any(self.satisfied(p, rows, numbers, c) for p in n.parts)
        if isinstance(n, t.Group):
            groups = {r[1] for r in rows + numbers} - {0}
            good = [g for g in groups if self.satisfied(n.of, [r for r in rows if r[1] == g], [r for r in numbers if r[1] == g], c)]
            return self.within(len(good), n)
        types = self.of(n.name) if not isinstance(n.name, t.Any) else None
        named = lambda r: types is None or r[2] in types
        if isinstance(n.value, t.Value):
            want = Decimal(n.value.values[0])
            test = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[n.op]
            return self.within(sum(named(r) and getattr(Decimal(r[3]), test)(want) for r in numbers), n)
        inside = set(self.concept) if isinstance(n.value, t.Any) else self.of(n.value)
        if n.reverse:
            active = {s for s in self.concept if self.concept[s][2]}
            return self.within(len({s for s in active for r in self.all_rows(s) if r[3] == c and named(r) and (s in inside) == (n.op == "=")}), n)
        return self.within(sum(named(r) and (r[3] in inside) == (n.op == "=") for r in rows), n)

