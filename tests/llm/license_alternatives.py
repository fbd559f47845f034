"""All alternatives of a licence expression, written out: exponential, for comparison only."""

from braidlex.llm.license_scan import _BINDS, _TOKEN, to_postfix


def evaluate(expression: str) -> tuple[frozenset[frozenset[str]], bool]:
    """The alternatives (each a set of licences to follow; they can be many), and whether the expression is well formed."""
    postfix = to_postfix(expression)
    if postfix is None:
        named = frozenset(t.lower() for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _BINDS)
        return (frozenset({named}) if named else frozenset()), False
    stack: list[frozenset[frozenset[str]]] = []
    for token in postfix:
        if token == "or":
            right, left = stack.pop(), stack.pop()
            stack.append(left | right)
        elif token == "and":
            right, left = stack.pop(), stack.pop()
            stack.append(frozenset(a | b for a in left for b in right))
        elif token == "with":
            right, left = stack.pop(), stack.pop()
            exception = "-or-".join(sorted({x for s in right for x in s}))
            stack.append(frozenset(frozenset(f"{x}-with-{exception}" for x in s) for s in left))
        else:
            stack.append(frozenset({frozenset({token})}))
    return stack[0], True
