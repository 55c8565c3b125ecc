"""What a TypeScript or JavaScript file exports, imports, calls and says: read off its tree.

* entities: the file, its exported functions, classes with their methods, and constants that are functions; other exports are
  left out, the first of an id stays.  A class counts the statements of its methods, a file those at its top level.
* imports: one row per imported name, with what the file refers to outside its imports.
* calls: callee text, its root and last name, and the entity around.
* literals: texts of four characters or more outside imports, exports and types, with the role of what holds them.
"""

from __future__ import annotations

import hashlib
import posixpath
import re

from driftloom.syntax.grammars import _begin, grammar
from driftloom.syntax.peg import Parsed
from driftloom.syntax.tree import Node, tree

#: Modules whose imports, and calls, that act outside the program; fixed values.
EFFECT_MODULES = frozenset("node:fs node:fs/promises fs fs/promises node:net net node:http http node:https https node:child_process child_process".split())
EFFECT_CALLS = frozenset("fetch setTimeout setInterval setImmediate process.nextTick process.exit process.kill spawn exec fork query".split())
#: The shortest text that is taken for a contract; fixed value.
MIN_LITERAL = 4
_STATEMENTS = {"VariableStatement", "If", "For", "While", "Do", "Switch", "Try", "Expression"}
_BODIES = ("FunctionBody", "GeneratorBody", "ArrowBody", "ConstructorBody")
_FUNCTIONS = ("Arrow", "PlainArrow", "FunctionExpression")
_TYPES = {"Type", "ReturnType", "TypeParameters", "TypeArguments", "TypeReference", "ObjectType", "InterfaceDeclaration", "TypeDeclaration"}
#: Rules that only pass on a single part.
_THIN = {"Expression", "Substitution", "Assign", "PlainAssign", "Conditional", "Binary", "Unary", "Postfix", "LeftHand", "Primary", "Argument_"}


def _unwrap(n: Node) -> Node:
    """The innermost node that is the whole of `n`."""
    while n.rule in _THIN and len(n.children) == 1:
        n = n.children[0]
    return n


class _File:
    def __init__(self, text: str, language: str, path: str):
        self.text, self.path = text, path
        self.p = Parsed(grammar(language), text, at := _begin(text))
        self.items: list[Node] = []
        self.ok = True
        item = self.p.rules["ModuleItem"]
        while self.p.token(at)[0] != "e":
            end = item(at)
            if end < 0:
                self.ok = False
                break
            self.items.append(tree(self.p, "ModuleItem", at).children[0])
            at = end

    def of(self, n: Node) -> str:
        return self.text[n.start : n.end]

    def words(self, n: Node) -> list[str]:
        return [self.of(c) for c in n.children if not c.rule]

    # ------------------------------------------------------------ declarations

    def declared(self, d: Node) -> list[tuple[str, str, Node, Node]]:
        """(name, type, node, function or class) of a declaration that can be an entity."""
        if d.rule in ("FunctionDeclaration", "DefaultFunction"):
            names = [w for w in self.words(d) if w not in ("async", "function", "*")]
            return [(names[0] if names else "default", "function", d, d)]
        if d.rule in ("ClassDeclaration", "ClassExpression"):
            names = [w for w in self.words(d) if w not in ("abstract", "class")]
            return [(names[0] if names else "default", "class", d, d)]
        out = []
        if d.rule == "VariableStatement":
            for v in d.first("VariableList").all("Variable", "Constant"):
                value = v.first("Assign")
                name = v.first("Target") or v.children[0]
                f = _unwrap(value) if value else None
                if f is not None and f.rule in _FUNCTIONS and re.fullmatch(r"[\w$]+", self.of(name)):
                    out.append((self.of(name), "function", v, f))
        return out

    def exports(self) -> list[tuple[str, str, Node, Node]]:
        """(exported name, type, node, function or class) in the order of the exports."""
        local = {x[0]: x for i in self.items for d in ([i.children[0]] if i.rule == "Statement" and i.children else i.children if i.rule == "ExportItem" else []) for x in self.declared(d)}
        out = []
        for i in self.items:
            if i.rule != "ExportItem":
                continue
            for d in i.children:
                if d.rule == "ExportDefault":
                    inner = d.first("DefaultFunction", "ClassExpression", "Assign")
                    target = local.get(self.of(inner)) if inner is not None and inner.rule == "Assign" else None
                    found = [target] if target else self.declared(inner) if inner is not None and inner.rule != "Assign" else []
                    out += [("default", *x[1:]) for x in found]
                elif d.rule == "ExportNames" and "from" not in self.words(i):
                    for spec in d.all("ExportSpec"):
                        names = [w for w in self.words(spec) if w not in ("as", "type")]
                        if names and names[0] in local:
                            out.append((names[-1], *local[names[0]][1:]))
                else:
                    out += self.declared(d)
        return out

    def methods(self, c: Node) -> list[tuple[str, Node]]:
        """(name, element) of the methods of a class; constructors and accessors are none."""
        out = []
        tail = c.first("ClassTail")
        for e in tail.all("ClassElement") if tail else []:
            name = e.first("PropertyName")
            if name is not None and e.first("Signature") and not {"get", "set", "constructor"} & set(self.words(e)):
                out.append((self.of(name).strip("'\""), e))
        return out

    def signature(self, f: Node) -> str:
        s = f.first("Signature")
        if s is None:  # an arrow of one bare parameter
            return f"({', '.join(self.of(x) for x in f.all('Parameters')) or self.words(f)[-2 if len(self.words(f)) > 1 else 0]})"
        inner = s.first("DistinctParameters")
        params = (inner.first("Parameters") if inner else s.first("Parameters")) if inner or s.first("Parameters") else None
        returns = s.first("ReturnAnnotation_")
        return f"({', '.join(self.of(x) for x in params.all('Parameter')) if params else ''})" + (": " + self.of(returns).lstrip(":").strip() if returns else "")

    def extends(self, c: Node) -> str:
        tail = c.first("ClassTail")
        base = tail.first("LeftHand") if tail else None
        args = tail.first("TypeArguments") if tail else None
        return f" extends {self.of(base)}{self.of(args) if args else ''}" if base is not None else ""

    # ------------------------------------------------------------ measures

    def is_statement(self, n: Node) -> bool:
        if n.rule != "Statement" or not n.children:
            return False
        k = n.children[0]
        return k.rule in _STATEMENTS or not k.rule and self.of(k) in ("return", "throw")

    def inside(self, f: Node) -> list[Node]:
        """The bodies in which a function's statements and calls stand: its block, or the expression of an arrow."""
        return f.all(*_BODIES) or (f.all("Assign", "PlainAssign") if f.rule in _FUNCTIONS else [])

    def statements(self, n: Node) -> int:
        if n.rule in ("ClassDeclaration", "ClassExpression"):
            return sum(self.statements(m) for _, m in self.methods(n))
        return sum(self.is_statement(x) for b in self.inside(n) for x in b.walk())

    def file_statements(self) -> int:
        total = 0
        for i in self.items:
            if i.rule == "Statement" and self.is_statement(i):
                total += 1
                continue
            for d in [i.children[0]] if i.rule == "Statement" and i.children else i.children if i.rule == "ExportItem" else []:
                if d.rule == "VariableStatement":
                    total += 1
                elif d.rule in ("FunctionDeclaration", "DefaultFunction", "ClassDeclaration", "ClassExpression"):
                    total += self.statements(d)
                elif d.rule == "ExportDefault":
                    total += sum(self.statements(x) for x in d.all("DefaultFunction", "ClassExpression"))
        return total

    def call_sites(self, n: Node) -> list[tuple[str, int, int]]:
        """(callee, its start, start of the arguments) of every call inside `n`; `new` is none."""
        out = []
        for x in n.walk():
            if x.rule == "LeftHand":
                for s in x.children[1:]:
                    if s.rule == "Suffix_" and s.first("Arguments"):
                        callee = self.text[x.start : s.start].rstrip("?. \n\t")
                        out.append((callee, x.start, s.start))
        return out

    def effects(self, n: Node, names: set[str]) -> bool:
        for callee, _, _ in self.call_sites(n):
            root, last = re.split(r"[.(]", callee)[0], callee.rsplit(".", 1)[-1]
            if root in names or callee in EFFECT_CALLS or last in EFFECT_CALLS:
                return True
        return any(x.rule in ("Assign", "PlainAssign") and x.first("AssignmentOperator_") and self.of(x).startswith("process.env") for x in n.walk())

    # ------------------------------------------------------------ tables

    def references(self, n: Node) -> set[str]:
        """Names that a node refers to: identifiers that are no property, type names, and the short form of a property."""
        out: set[str] = set()
        for x in n.walk():
            if x.rule in ("Primary", "NewTarget", "SimpleTarget", "TypeReference", "EntityName", "Property") and x.children and not x.children[0].rule:
                w = self.of(x.children[0])
                if (x.rule != "Property" or len(x.children) == 1) and re.fullmatch(r"[^\W\d][\w$]*|\$[\w$]*", w):
                    out.add(w)
        return out

    def imports(self, used: set[str]) -> list[dict]:
        out = []
        for i in self.items:
            if i.rule != "ImportItem":
                continue
            clause, words = i.first("ImportClause"), self.words(i)
            module = next((w[1:-1] for w in words if w[:1] in "'\""), "")
            whole = "type" in words and clause is not None
            target = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), module)) if module[:1] == "." else None

            def add(local: str, imported: str, kind: bool) -> None:
                out.append({"local": local, "imported": imported, "module": module, "type_only": whole or kind, "external": module[:1] not in ("", ".", "/"), "referenced": local in used, "target": target})  # noqa: B023

            for c in clause.children if clause else []:
                if not c.rule and self.of(c) != ",":
                    add(self.of(c), "default", False)
                elif c.rule == "NamespaceImport_":
                    add(self.words(c)[-1], "*", False)
                elif c.rule == "NamedImports":
                    for s in c.all("ImportSpec"):
                        w = self.words(s)
                        typed = len(w) > 1 and w[0] == "type" and w[1] != "as"
                        w = w[1:] if typed else w
                        add(w[-1], w[0].strip("'\""), typed)
        return out

    def literals(self) -> list[dict]:
        out, todo = [], [(i, "SourceFile") for i in reversed(self.items) if i.rule != "ImportItem"]
        while todo:
            n, role = todo.pop()
            if n.rule in _TYPES or n.rule == "ExportItem" and "from" in self.words(n):
                continue
            if not n.rule or n.rule == "TEMPLATE" and not n.children:
                t = self.of(n)
                if t[:1] in "'\"`" and len(t) - 2 >= MIN_LITERAL and "${" not in t:
                    out.append({"value": t[1:-1], "role": role, "offset": n.start})
                if not n.rule:
                    continue
            here = role if n.rule in _THIN and len(n.children) == 1 or n.rule == "TEMPLATE" and not n.children else n.rule
            if n.rule == "Binary" and len(n.children) > 1:
                here = "Binary"
            todo += [(c, f"Arguments[{k}]" if n.rule == "Arguments" and c.rule == "Argument_" else here) for k, c in reversed(list(enumerate(c for c in n.children if c.rule or self.of(c)[:1] in "'\"")))]
        return out


def extract(text: str, language: str, path: str) -> dict:
    """entities, imports, calls and literals of a file; of a file that does not parse, what stands before the failure."""
    f = _File(text, language, path)
    body = [i for i in f.items if i.rule != "ImportItem"]
    used = set().union(*map(f.references, body)) if body else set()
    imports = f.imports(used)
    effect_names = {x["local"] for x in imports if x["module"] in EFFECT_MODULES}
    line = lambda at: text.count("\n", 0, at) + 1
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    entities, seen = [], set()

    def add(kind: str, name: str, signature: str, start: int, end: int, n_statements: int, effects: bool, refs: set[str]) -> None:
        id_ = f"file:{path}" if kind == "file" else f"symbol:{path}#{name}"
        if id_ not in seen:
            seen.add(id_)
            entities.append({
                "id": id_, "type": kind, "name": name, "signature": signature, "start_offset": start, "end_offset": end, "start_line": line(start), "end_line": line(end), "content_hash": sha(text[start:end]),
                "n_statements": n_statements, "side_effects": effects, "refs": sorted(refs),
            })

    add("file", path.rsplit("/", 1)[-1], path.rsplit("/", 1)[-1], 0, len(text), f.file_statements(), any(f.effects(i, effect_names) for i in body), used)
    spans = []
    for name, kind, node, what in f.exports():
        if kind == "class":
            add("class", name, f"class {name}{f.extends(what)}", node.start, node.end, f.statements(what), f.effects(what, effect_names), f.references(what))
            own = next((w for w in f.words(what) if w not in ("abstract", "class")), name)
            for method, m in f.methods(what):
                add("method", f"{own}.{method}", f"{own}.{method}{f.signature(m)}", m.start, m.end, f.statements(m), any(f.effects(b, effect_names) for b in f.inside(m)), f.references(m))
        else:
            add("function", name, name + f.signature(what), node.start, node.end, f.statements(what), any(f.effects(b, effect_names) for b in f.inside(what)), f.references(what))
    spans = sorted(((e["end_offset"] - e["start_offset"], e["start_offset"], e["end_offset"], e["id"]) for e in entities))
    around = lambda at: next(i for _, s, e, i in spans if s <= at < e)
    calls = [{"entity": around(at), "callee": c, "root": re.split(r"[.(]", c)[0], "last": c.rsplit(".", 1)[-1], "offset": at} for i in body for c, at, _ in f.call_sites(i)]
    literals = [x | {"entity": around(x["offset"])} for x in f.literals()]
    return {"parsed": f.ok, "entities": entities, "imports": imports, "calls": calls, "literals": literals}

