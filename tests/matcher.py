"""A plain matcher of filters on documents, to hold the compilers against."""

from quarry.functions.values import order_bytes

MISSING = object()


def key(v):
    return order_bytes(v)


def is_ops(c):
    return isinstance(c, dict) and bool(c) and all(k.startswith("$") for k in c)


def matches(doc, query):
    if not isinstance(query, dict):
        return False
    for k, c in query.items():
        if k == "$and":
            if not (isinstance(c, list) and all(isinstance(q, dict) and matches(doc, q) for q in c)):
                return False
        elif k == "$or":
            if not (isinstance(c, list) and any(isinstance(q, dict) and matches(doc, q) for q in c)):
                return False
        elif k == "$not":
            return False
        elif not condition(doc.get(k, MISSING) if isinstance(doc, dict) else MISSING, c):
            return False
    return True


def condition(v, c):
    if is_ops(c):
        return all(op(v, o, x) for o, x in c.items())
    return v is not MISSING and key(v) == key(c)


def op(v, o, x):
    gone = v is MISSING
    if o == "$eq":
        return x is None if gone else key(v) == key(x)
    if o == "$ne":
        return not op(v, "$eq", x)
    if o in ("$gt", "$gte", "$lt", "$lte"):
        if gone:
            return False
        a, b = key(v), key(x)
        return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[o]
    if o == "$in":
        return isinstance(x, list) and any(op(v, "$eq", y) for y in x)
    if o == "$nin":
        return isinstance(x, list) and not op(v, "$in", x)
    if o == "$not":
        return is_ops(x) and not condition(v, x)
    if o == "$exists":
        return isinstance(x, bool) and (not gone) == x
    if o == "$elemMatch":
        if not isinstance(v, list):
            return False
        if is_ops(x):
            return any(all(op(e, oo, y) for oo, y in x.items()) for e in v)
        if isinstance(x, dict):
            return any(matches(e, x) for e in v)
        return any(key(e) == key(x) for e in v)
    return False
