"""Random syntax trees, and what they look like in either syntax."""

from conceptmill.ecl import tree as t

SHORT = {"<": "<", "<<": "<<", "<!": "<!", "<<!": "<<!", ">": ">", ">>": ">>", ">!": ">!", ">>!": ">>!", "!!>": "!!>", "!!<": "!!<"}
LONG = {"<": "descendantOf", "<<": "descendantOrSelfOf", "<!": "childOf", "<<!": "childOrSelfOf", ">": "ancestorOf", ">>": "ancestorOrSelfOf", ">!": "parentOf", ">>!": "parentOrSelfOf", "!!>": "top", "!!<": "bottom"}


class Maker:
    """Trees over given concepts, attribute types, reference sets and numbers."""

    def __init__(self, rng, concepts, types, refsets, modules=(), numbers=("0", "1.5", "-2")):
        self.rng, self.concepts, self.types, self.refsets, self.modules, self.numbers = rng, concepts, types, refsets, list(modules) or concepts[:2], numbers

    def expression(self, depth=3):
        r = self.rng
        if depth <= 0 or r.random() < 0.2:
            return t.Any() if r.random() < 0.2 else t.Concept(r.choice(self.concepts))
        kind = r.choice(["hierarchy", "hierarchy", "and", "or", "minus", "members", "containing", "refined", "refined", "refined", "metadata", "members_filtered"])
        if kind == "hierarchy":
            return t.Hierarchy(r.choice(list(SHORT)), self.expression(depth - 1))
        if kind in ("and", "or"):
            parts = tuple(self.expression(depth - 1) for _ in range(r.randint(2, 3)))
            return (t.And if kind == "and" else t.Or)(parts)
        if kind == "minus":
            return t.Minus(self.expression(depth - 1), self.expression(depth - 1))
        if kind == "members":
            return t.Members(t.Concept(r.choice(self.refsets)))
        if kind == "members_filtered":
            op = r.choice(["=", "!=", "<", ">="])
            f = [t.MemberFilter("moduleId", r.choice(["=", "!="]), "concept", t.Concept(r.choice(self.modules))), t.MemberFilter("active", "=", "active", r.random() < 0.5), t.MemberFilter("effectiveTime", op, "dateortext" if op in ("=", "!=") else "date", (r.choice([20210101, 20220202]),))]
            return t.Members(t.Concept(r.choice(self.refsets)), None, False, tuple(r.sample(f, r.randint(1, 2))))
        if kind == "containing":
            return t.Members(self.expression(depth - 1), None, True)
        if kind == "metadata":
            options = [t.Filter("active", r.choice(["=", "!="]), r.random() < 0.5), t.Filter("definitionStatus", "=", ("defined",)), t.Filter("moduleId", r.choice(["=", "!="]), t.Concept(r.choice(self.modules))), t.Filter("effectiveTime", r.choice(["=", ">", "<="]), (20210101,))]
            return t.Filtered(self.expression(depth - 1), "C", tuple(r.sample(options, r.randint(1, 2))))
        return t.Refined(self.expression(depth - 1), self.refinement(depth - 1, False))

    def bounds(self):
        return self.rng.choice([(1, None)] * 6 + [(0, 0), (0, 1), (2, None), (1, 1), (0, None), (2, 3)])

    def refinement(self, depth, grouped):
        r = self.rng
        kind = r.random()
        if depth > 0 and kind < 0.35:
            parts = tuple(self.refinement(depth - 1, grouped) for _ in range(2))
            made = r.choice([t.AllOf, t.AnyOf])
            return made(parts)
        if depth > 0 and not grouped and kind < 0.55:
            least, most = self.bounds()
            return t.Group(self.refinement(depth - 1, True), least, most)
        least, most = self.bounds()
        name = t.Concept(r.choice(self.types)) if r.random() < 0.8 else t.Any()
        if r.random() < 0.25:
            return t.Attribute(name, r.choice(["=", "!=", "<", "<=", ">", ">="]), t.Value("number", (r.choice(self.numbers),)), least, most)
        reverse = not grouped and r.random() < 0.2
        return t.Attribute(name, r.choice(["=", "=", "!="]), self.expression(depth - 1), least, most, reverse)


class Printer:
    """Tokens of a tree; ``long`` chooses the words of the long syntax, ``rng`` the blanks and comments between tokens."""

    def __init__(self, long=False, rng=None):
        self.long, self.rng = long, rng

    def text(self, node) -> str:
        return self.joined(self.tokens(node))

    def joined(self, tokens) -> str:
        gap = lambda: self.rng.choice([" ", "  ", "\t", "\n", " /* aside */ "]) if self.rng else " "
        return "".join(x for token in tokens for x in (token, gap())).strip()

    def tokens(self, node) -> list[str]:
        if isinstance(node, t.Concept):
            return [str(node.id)]
        if isinstance(node, t.Any):
            return ["any" if self.long else "*"]
        if isinstance(node, t.Hierarchy):
            return [(LONG if self.long else SHORT)[node.op], *self.operand(node.of)]
        if isinstance(node, (t.And, t.Or)):
            word = ("and" if self.long else "AND") if isinstance(node, t.And) else ("or" if self.long else "OR")
            return self.between(word, map(self.operand, node.parts))
        if isinstance(node, t.Minus):
            return [*self.operand(node.left), "minus" if self.long else "MINUS", *self.operand(node.right)]
        if isinstance(node, t.Members):
            word = ("refsetContainingAny" if self.long else "^R") if node.reverse else ("memberOf" if self.long else "^")
            return [word, *self.operand(node.of), *(["{{", "M", *self.between(",", [self.filter(f) for f in node.filters]), "}}"] if node.filters else [])]
        if isinstance(node, t.Filtered):
            return [*self.operand(node.of), "{{", node.kind, *self.between(",", [self.filter(f) for f in node.filters]), "}}"]
        if isinstance(node, t.Refined):
            return [*self.operand(node.of), ":", *self.refinement(node.refinement)]
        raise TypeError(node)

    def operand(self, node) -> list[str]:
        plain = self.tokens(node)
        return plain if isinstance(node, (t.Concept, t.Any)) else ["(", *plain, ")"]

    @staticmethod
    def between(token, parts) -> list[str]:
        out: list[str] = []
        for part in parts:
            out += [token, *part] if out else part
        return out

    def op(self, op) -> str:
        return "<>" if self.long and op == "!=" else op

    def filter(self, f) -> list[str]:
        v = f.value
        if f.field == "active":
            told = ["1" if v else "0"]
        elif f.field == "definitionStatus":
            told = list(v)
        elif f.field == "effectiveTime":
            told = [f'"{v[0]}"']
        else:
            told = self.operand(v)
        return [f.field, self.op(f.op), *told]

    def bounds(self, node) -> list[str]:
        if (node.least, node.most) == (1, None):
            return []
        most = ("many" if self.long else "*") if node.most is None else str(node.most)
        return [f"[{node.least}{' to ' if self.long else '..'}{most}]"]

    def refinement(self, node) -> list[str]:
        if isinstance(node, (t.AllOf, t.AnyOf)):
            word = ("and" if self.long else ",") if isinstance(node, t.AllOf) else ("or" if self.long else "OR")
            return self.between(word, [["(", *self.refinement(p), ")"] if isinstance(p, (t.AllOf, t.AnyOf)) else self.refinement(p) for p in node.parts])
        if isinstance(node, t.Group):
            return [*self.bounds(node), "{", *self.refinement(node.of), "}"]
        value = [f"#{node.value.values[0]}"] if isinstance(node.value, t.Value) else self.operand(node.value)
        return [*self.bounds(node), *(["reverseOf" if self.long else "R"] if node.reverse else []), *self.operand(node.name), self.op(node.op), *value]
