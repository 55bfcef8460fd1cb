"""Index descriptions as strings, such as "OPQ8_32,IVF64,PQ8" or "IDMap,IVF16(HNSW8),Flat", parsed into a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from vexel.plans.storage import materialize


@dataclass(frozen=True)
class Node:
    """kind is transform, flat, codec, ivf, graph, idmap or refine; args are the numbers and words in the token."""

    kind: str
    name: str
    args: tuple = ()
    children: tuple = field(default_factory=tuple)


NORMS = "(?:_N(float|none|qint8|qint4|cqint8|cqint4|lsq2x4|rq2x4))?"
TRANSFORMS = [("PCA", r"PCA(W?)(R?)(\d+)"), ("L2norm", "L2norm"), ("RR", r"RR(\d*)"), ("ITQ", r"ITQ(\d*)"), ("OPQ", r"OPQ(\d+)(?:_(\d+))?"), ("Pad", r"Pad(\d+)")]
CODECS = [
    ("Flat", "Flat"), ("FlatDedup", "FlatDedup"), ("LSH", "LSH(r?)(t?)"), ("Lattice", r"ZnLattice(\d+)x(\d+)_(\d+)"), ("SQ", "SQ(4|6|8|fp16)"),
    ("PQfs", r"PQ(\d+)x4fs(r?)(?:_(\d+))?"), ("PQR", r"PQ(\d+)\+(\d+)"), ("PQ", r"PQ(\d+)(?:x(\d+))?(np)?"),
    ("AQfs", rf"(RQ|LSQ)(\d+)x4fs(r?){NORMS}"), ("PAQfs", rf"(PRQ|PLSQ)(\d+)x(\d+)x4fs(r?){NORMS}"), ("RQ", rf"(RC?Q)(\d+(?:x\d+)?(?:_\d+x\d+)*){NORMS}"),
    ("LSQ", rf"(LSC?Q)(\d+)x(\d+){NORMS}"), ("PAQ", rf"(PRQ|PLSQ)(\d+)x(\d+)x(\d+){NORMS}"), ("SH", r"SH(\d+(?:\.\d+)?)?([gcm]?)"),
]
COARSE = [("IVF", r"IVF(\d+)(?:_(HNSW|NSG)(\d*))?(\(.*\))?"), ("IMI", r"IMI2x(\d+)"), ("Residual", r"Residual(\d+)(?:x(\d+))?")]
GRAPHS = [("HNSW", r"HNSW(\d*)"), ("NSG", r"NSG(\d*)")]
GRAPH_CODES = [*CODECS, ("2Level", r"(\d+|2x\d+)\+PQ(\d+)")]
BINARY = [("BFlat", "BFlat"), ("BIVF", r"BIVF(\d+)(?:_HNSW(\d+))?"), ("BHNSW", r"BHNSW(\d+)"), ("BHash", r"BHash(\d+)(?:x(\d+))?")]


def _match(token: str, table: list[tuple[str, str]]) -> tuple[str, tuple] | None:
    for name, pattern in table:
        if m := re.fullmatch(pattern, token):
            return name, tuple(int(g) if g and g.isdigit() else g for g in m.groups())
    return None


def split(text: str) -> list[str]:
    """At commas outside parentheses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise ValueError(f"unbalanced parentheses in {text!r}")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    if depth:
        raise ValueError(f"unbalanced parentheses in {text!r}")
    return [*parts, text[start:]]


def parse(text: str) -> Node:
    return _tokens(split(text.strip()), text)


def _tokens(tokens: list[str], whole: str) -> Node:
    if not tokens or not tokens[0]:
        raise ValueError(f"could not parse {whole!r}")
    last = tokens[-1]
    if len(tokens) > 1 and last == "RFlat":
        return Node("refine", "RFlat", (), (_tokens(tokens[:-1], whole), Node("flat", "Flat")))
    if len(tokens) > 1 and (m := re.fullmatch(r"Refine\((.*)\)", last)):
        return Node("refine", "Refine", (), (_tokens(tokens[:-1], whole), parse(m[1])))
    head, rest = tokens[0], tokens[1:]
    if head in ("IDMap", "IDMap2"):
        return Node("idmap", head, (), (_tokens(rest, whole),))
    if last in ("IDMap", "IDMap2") and len(tokens) > 1:
        return Node("idmap", last, (), (_tokens(tokens[:-1], whole),))
    if rest and (t := _match(head, TRANSFORMS)):
        return Node("transform", t[0], t[1], (_tokens(rest, whole),))
    if head.startswith("(") and head.endswith(")"):
        return parse(head[1:-1]) if not rest else _fail(whole)
    if head in ("MinMax", "MinMaxFP16"):
        return Node("codec", head, (), (_tokens(rest, whole),))
    if c := _match(head, COARSE):
        args, inner = c[1], None
        if c[0] == "IVF" and args[3]:
            inner, args = parse(args[3][1:-1]), (*args[:3], None)
        code = _tokens(rest, whole) if rest else Node("flat", "Flat")
        return Node("ivf", c[0], args, tuple(n for n in (inner, code) if n))
    if g := _match(head, GRAPHS):
        code = _match(rest[0], GRAPH_CODES) if rest else ("Flat", ())
        if code is None or len(rest) > 1:
            return _fail(whole)
        return Node("graph", g[0], (g[1][0] or 32,), (Node("codec", *code),))
    if not rest:
        if b := _match(head, BINARY):
            return Node("binary", *b)
        if c := _match(head, CODECS):
            return Node("flat" if c[0] == "Flat" else "codec", *c)
    return _fail(whole)


def _fail(whole: str):
    raise ValueError(f"could not parse {whole!r}")


def describe(node: Node) -> str:
    """A readable form of the tree."""
    own = node.name + "".join(f"[{a}]" for a in node.args if a not in (None, ""))
    return own + (f"({', '.join(map(describe, node.children))})" if node.children else "")


def codec_of(node: Node):
    """An unfitted codec for a leaf that has one."""
    from vexel.operators import quantizers as Q

    name, args = node.name, node.args
    if node.kind == "codec" and name in ("MinMax", "MinMaxFP16"):
        return Q.RowScaled(codec_of(node.children[0]), name == "MinMaxFP16")
    if name == "SQ":
        return Q.Half() if args[0] == "fp16" else Q.Scalar(args[0])
    if name == "PQ":
        return Q.Product(args[0], args[1] or 8)
    if name == "PQfs":
        return Q.Product(args[0], 4)
    if name == "RQ":
        groups = [list(map(int, g.split("x"))) if "x" in g else [int(g), 8] for g in str(args[1]).split("_")]  # RQ8: eight books of 8 bits
        bits = tuple(b for m, b in groups for _ in range(m))
        plain = Q.Residual(len(bits), bits)
    elif name == "LSQ":
        plain = Q.LocalSearch(args[1], args[2])
    elif name == "AQfs":
        plain = (Q.Residual if args[0] == "RQ" else Q.LocalSearch)(args[1], 4)
    elif name in ("PAQ", "PAQfs"):
        plain = Q.ProductAdditive(args[1], Q.Residual if args[0] == "PRQ" else Q.LocalSearch, args[2], args[3] if name == "PAQ" else 4)
    else:
        raise NotImplementedError(f"{name} parses, but has no builder here")
    return Q.Normed(plain, args[-1]) if args[-1] else plain


def _bits(codec, d: int) -> int:
    """Bits of a code of d dimensions, known before the codec is fitted."""
    from vexel.operators import quantizers as Q

    if isinstance(codec, Q.RowScaled):
        return (32 if codec.half else 64) + _bits(codec.codec, d)
    if isinstance(codec, Q.Normed):
        return _bits(codec.codec, d) + {"none": 0, "float": 32, "qint8": 8, "cqint8": 8, "qint4": 4, "cqint4": 4}.get(codec.kind, 8)
    if isinstance(codec, Q.ProductAdditive):
        return codec.slices * codec.m * codec.bits
    return 16 * d if isinstance(codec, Q.Half) else codec.bits * d if isinstance(codec, Q.Scalar) else sum(codec.widths)


def code_size(node: Node, d: int) -> int:
    """Bytes of one stored vector."""
    if node.kind in ("idmap", "refine", "ivf", "graph"):
        return (8 if node.kind in ("idmap",) else 0) + sum(code_size(c, d) for c in (node.children if node.kind == "refine" else node.children[-1:]))
    if node.kind == "transform":
        out = {"PCA": lambda: node.args[2], "OPQ": lambda: node.args[1] or d, "Pad": lambda: node.args[0], "RR": lambda: node.args[0] or d, "ITQ": lambda: node.args[0] or d, "L2norm": lambda: d}[node.name]()
        return code_size(node.children[0], out)
    if node.name in ("Flat", "FlatDedup"):
        return 4 * d
    if node.name == "LSH":
        return (d + 7) // 8
    if node.name == "PQR":
        return node.args[0] + node.args[1]
    return (_bits(codec_of(node), d) + 7) // 8


def build(text: str, base, metric: str = "l2"):
    """An index over base (id, vec; id, code for binary strings): an object with search(queries, k, ...). Rows have ids of their own, which IDMap keeps; what has no builder raises NotImplementedError."""
    from vexel.operators import binary, coarse, coded, flat, graph, ivf, quantizers, transforms
    from vexel.operators.cluster import Kmeans

    node = parse(text)
    if node.kind == "binary":
        from vexel.operators import bits

        n, m = (*node.args, None, None)[:2]
        if node.name == "BHash":
            return bits.HashTables.build(base, m or n, n if m else 1)
        return {"BFlat": lambda: bits.BinaryIndex.flat(base), "BIVF": lambda: bits.BinaryIndex.lists(base, n, graph=m or 0), "BHNSW": lambda: bits.BinaryIndex.graph(base, n)}[node.name]()

    class Searcher:
        def __init__(self, f):
            self.search = f

    def bits_below(n: Node) -> int:
        """Bits of the product codes that a rotation is fitted for."""
        while n.children:
            n = n.children[-1]
        return (n.args[1] or 8) if n.name == "PQ" else 4

    def only_l2(what: str) -> None:
        if metric != "l2":
            raise ValueError(f"{what} is for L2 only")

    def coarse_of(n: Node, rows):
        """The quantizer that gives lists."""
        if n.name == "IMI":
            only_l2("a multi-index")
            return coarse.MultiIndex.fit(rows, n.args[0])
        if n.name == "Residual" and n.args[1]:
            only_l2("a multi-index")
            return coarse.MultiIndex.fit(rows, n.args[1], n.args[0])
        if n.name == "IVF" and len(n.children) > 1 and n.children[0].name in ("RQ", "LSQ") and n.children[0].args[0] in ("RCQ", "LSCQ"):
            found = coarse.Additive.fit(rows, codec_of(n.children[0]))
            if found.size != n.args[0]:
                raise ValueError(f"{n.args[0]} lists, but {found.size} sums of codebooks")
            return found
        found = coarse.Centroids(Kmeans(n.args[0], spherical=metric == "ip").fit(rows).centroids, metric)
        if n.name == "IVF" and n.args[1]:
            centres = coarse._table(rows.sparkSession, found.centroids)
            found.searcher, found.options = graph.GraphIndex.build(centres, 1, n.args[2] or 32, metric=metric, kind=n.args[1].lower()), {"ef": max(64, found.size // 4)}
        elif n.name == "IVF" and len(n.children) > 1:
            found.searcher = make(n.children[0], coarse._table(rows.sparkSession, found.centroids))
        return found

    def two_layers(leaf: Node, rows):
        """Codes of what is left of a list's centre: "64+PQ8" or "2x5+PQ8"."""
        lists, m = str(leaf.args[0]), leaf.args[1]
        by = coarse.MultiIndex.fit(rows, int(lists[2:])) if "x" in lists else coarse.Centroids(Kmeans(int(lists)).fit(rows).centroids)
        return coded.FlatCodes.build(rows, quantizers.Product(m), metric, by)

    def lists_of(n: Node, rows):
        leaf, by = n.children[-1], coarse_of(n, rows)
        if n.name == "Residual":
            return coded.FlatCodes.build(rows, codec_of(leaf), metric, by)
        if leaf.name == "Flat":
            return ivf.IvfIndex.around(by, rows, metric)
        if leaf.name == "FlatDedup":
            return ivf.DedupIndex.around(by, rows, metric)
        if leaf.name == "PQR":
            only_l2("a second residual code")
            return coded.CodedIvf.around(by, rows, quantizers.Product(leaf.args[0]), metric, True, quantizers.Product(leaf.args[1]))
        fast = leaf.name in ("PQfs", "AQfs", "PAQfs")  # these encode residuals only where the string says r
        return coded.CodedIvf.around(by, rows, codec_of(leaf), metric, not fast or "r" in leaf.args)

    def make(n: Node, rows):
        if n.kind == "idmap":
            return make(n.children[0], rows)
        if n.kind == "flat":
            return Searcher(lambda q, k, **o: flat.knn(rows, q, k, metric, **o))
        if n.kind == "transform":
            x = transforms.sample_matrix(rows)
            t = {
                "PCA": lambda: transforms.pca(rows, n.args[2], -0.5 if n.args[0] else 0.0, bool(n.args[1])), "RR": lambda: transforms.random_rotation(x.shape[1], n.args[0] or x.shape[1]),
                "OPQ": lambda: transforms.opq(x, n.args[0], rounds=5, bits=bits_below(n), out=n.args[1]), "ITQ": lambda: transforms.Linear(transforms.itq(x), x.mean(0) * 0),
            }.get(n.name)
            if n.name == "ITQ" and n.args[0] and n.args[0] != x.shape[1]:
                raise NotImplementedError("ITQ to fewer dimensions")
            if t is None and n.name == "Pad":
                inner = make(n.children[0], transforms.pad(rows, n.args[0]))
                return Searcher(lambda q, k, **o: inner.search(transforms.pad(q, n.args[0]), k, **o))
            if t is None and n.name == "L2norm":
                inner = make(n.children[0], transforms.normalize(rows))
                return Searcher(lambda q, k, **o: inner.search(transforms.normalize(q.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id"), k, **o))
            if t is None:
                raise NotImplementedError(n.name)
            fitted = t()
            inner = make(n.children[0], fitted.apply(rows))
            return Searcher(lambda q, k, **o: inner.search(fitted.apply(q.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id"), k, **o))
        if n.kind == "refine":
            inner, by = make(n.children[0], rows), n.children[1]
            if by.kind == "flat":
                finer = rows
            else:
                finer = coded.FlatCodes.build(rows, codec_of(by), metric).reconstruct()
            return Searcher(lambda q, k, k_factor=4, **o: quantizers.refine(inner.search(q, k * k_factor, **o), finer, q, k, metric))
        if n.kind == "ivf":
            return lists_of(n, rows)
        if n.kind == "graph":
            leaf = n.children[0]
            if leaf.name not in ("Flat", "PQ", "SQ", "2Level") or leaf.name == "2Level" and n.name == "NSG":
                raise NotImplementedError(f"a graph over {leaf.name}")
            stored = None if leaf.name == "Flat" else two_layers(leaf, rows) if leaf.name == "2Level" else coded.FlatCodes.build(rows, codec_of(leaf), metric)
            return graph.GraphIndex.build(rows if stored is None else stored.reconstruct().select("id", "vec"), m=n.args[0], metric=metric, kind=n.name.lower())
        if n.name in ("RQ", "LSQ") and n.args[0] in ("RCQ", "LSCQ"):
            return coarse.Additive.fit(rows, codec_of(n))
        if n.name == "LSH":
            turn, middle = n.args
            d = transforms.sample_matrix(rows).shape[1]
            a = transforms.random_rotation(d, d).a
            turned = (lambda t: transforms.map_vectors(t, lambda x: (x @ a.T).astype("float32"))) if turn else lambda t: t  # products differ in the last bits between batches; rounded, the same vector has the same code
            kept = materialize(turned(rows.select("id", "vec")), "turned") if turn else rows
            asked = lambda q: turned(q.selectExpr("query_id AS id", "vec")).withColumnRenamed("id", "query_id")
            thresholds = materialize(binary.medians(kept), "medians") if middle else None
            return Searcher(lambda q, k, **o: binary.lsh_search(kept, d, asked(q), k, thresholds, **o))
        if n.kind == "codec":
            index = codec_of(n)
            if n.name == "PQ" and not (len(n.args) > 2 and n.args[2]):
                index.polysemous = True  # Hamming distances of codes follow their own
            return coded.FlatCodes.build(rows, index, metric)
        raise NotImplementedError(f"{n.name} parses, but has no builder here")

    return make(node, base)
