"""Function-level metrics of Python files.

Its Python worker turns a text into a flat list of functions and classes.
Everything after that is column work on the same row, so no stage of it shuffles.

A function's complexity is the sum of the branch weights inside it. Rather than joining functions to
the branches they contain (m x k pairs per file), the parse keeps one running total of weights in
text order and notes it when a function starts and ends; the complexity is the difference.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reviewlake import catalog
from reviewlake.operators.findings import check_finding, explode_findings, file_keys, one_if
from reviewlake.operators.scan import LANGUAGE_PHASE, reviewable

NODE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("walk_ord", T.IntegerType()),
    T.StructField("weight_before", T.LongType()),
    T.StructField("weight_after", T.LongType()),
    T.StructField("documented", T.BooleanType()),
])
NODE_NAMES = tuple(NODE.fieldNames())
TREE = T.StructType([
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("error", T.StringType()),
    T.StructField("error_line", T.IntegerType()),
])


#: Statements parsed once that a worker keeps, and the longest text of one that it keeps.
MEMO_STATEMENTS, MEMO_CHARACTERS = 5_000, 4_000


def _parser():
    """The parse function, nested so that it travels to the workers by value.

    A text is parsed by its statements at the left margin, and a worker keeps what it learned of the last ones: one that comes
    again, in this file or another, also with other numbers in its names, is not parsed again. If each parses alone, so does
    the text, with the same nodes; if one does not, or the text has what may tie lines together, the whole text is parsed.
    """

    import ast
    import re

    kinds = {ast.FunctionDef: "function", ast.ClassDef: "class"}
    branches = {ast.If, ast.While, ast.For, ast.ExceptHandler}
    # Values and nodes that cannot have a branch below them.
    leaves = {type(None), str, int, bool, ast.Name, ast.Constant}
    for group in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop):
        leaves.update(group.__subclasses__())
    margin = re.compile(r"\n(?=[A-Za-z_@#])(?!(?:else|elif|except|finally)\b)")
    # Digits but 0 are alike to the parser, except in escapes and in binary and octal numbers.
    digits, apart = str.maketrans("23456789", "11111111"), ("\\", "0b", "0B", "0o", "0O")
    header = re.compile(r"\s*(?:def|class)\s+(\w+)")
    memo = {}

    def nodes_of(content):
        """Functions and classes in text order, as lists in the order of NODE, and the weight of all branches."""
        found, total = [], 0
        todo = [(ast.parse(content), 0)]
        while todo:
            node, depth = todo.pop()
            if depth < 0:  # everything inside this function or class is done
                node[6] = total
                continue
            kind = type(node)
            if kind in branches:
                total += 1
            elif kind is ast.BoolOp:
                total += len(node.values) - 1
            elif kind in kinds:
                row = [
                    kinds[kind], node.name, node.lineno, node.end_lineno, depth, total, total, bool(ast.get_docstring(node)),
                ]
                found.append(row)
                todo.append((row, -1))
            children = []
            for name in node._fields:
                value = getattr(node, name, None)
                if type(value) is list:
                    children += [(child, depth + 1) for child in value if type(child) not in leaves]
                elif type(value) not in leaves:
                    children.append((value, depth + 1))
            todo.extend(reversed(children))
        return found, total

    def statements(content):
        """Pieces that begin at the left margin; decorators go with what they decorate."""
        held = None
        for piece in margin.split(content):
            held = piece if held is None else f"{held}\n{piece}"
            if held[:1] != "@" or piece[:1] not in ("@", "#"):
                yield held
                held = None
        if held is not None:
            yield held

    def known_nodes(content):
        """``nodes_of`` by statements; None if the text must be parsed as one."""
        if "\r" in content or "\\\n" in content or "__future__" in content:
            return None
        renamed = content.isascii() and not any(text in content for text in apart)
        lines = content.split("\n") if renamed else None
        found, line, weight = [], 0, 0
        for piece in statements(content.translate(digits) if renamed else content):
            known = memo.get(piece)
            if known is None:
                try:
                    known = nodes_of(piece)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    return None
                if len(piece) <= MEMO_CHARACTERS:
                    if len(memo) >= MEMO_STATEMENTS:
                        memo.clear()
                    memo[piece] = known
            for kind, name, first, last, depth, before, after, documented in known[0]:
                if renamed:
                    name = header.match(lines[line + first - 1])[1]
                found.append((kind, name, line + first, line + last, depth, weight + before, weight + after, documented))
            weight += known[1]
            line += piece.count("\n") + 1
        return found

    def parse_batch(contents: pa.Array) -> pa.Array:
        import warnings

        offsets, rows, errors, lines = [0], [], [], []
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for content in contents.to_pylist():
                error, line = None, None
                try:
                    found = known_nodes(content)
                    found = nodes_of(content)[0] if found is None else found
                    # top level first and then by nesting, in text order
                    rows += [(*row[:4], at, *row[5:]) for at, row in enumerate(sorted(found, key=lambda row: row[4]))]
                except SyntaxError as wrong:
                    error, line = str(wrong), wrong.lineno
                except (ValueError, RecursionError, MemoryError) as wrong:
                    error = str(wrong) or type(wrong).__name__
                # no list where there is an error
                offsets[-1] = None if error is not None else offsets[-1]
                offsets.append(len(rows))
                errors.append(error)
                lines.append(line)
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [()] * len(types), types)]
        nodes = pa.StructArray.from_arrays(columns, [*NODE_NAMES])
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)
        return pa.StructArray.from_arrays(
            [listed, pa.array(errors, pa.string()), pa.array(lines, pa.int32())], ["nodes", "error", "error_line"]
        )

    # not deterministic to Catalyst, which would else copy the parse below filters on its result
    return F.arrow_udf(parse_batch, TREE).asNondeterministic()


def python_trees(files: DataFrame) -> DataFrame:
    """One row per Python file: its functions and classes, or its syntax error.

    Texts of other languages are filtered out before the Python worker, and no text comes back.
    """
    source = reviewable(files).where(F.col("ext").isin(*catalog.PYTHON_EXTENSIONS))
    tree = _parser()(F.col("content"))
    keys = file_keys(source)
    return source.select(*keys, tree.alias("tree")).select(*keys, "tree.*")


def _of_kind(kind: str) -> Column:
    return F.filter("nodes", lambda node: node.kind == kind)


def python_counts(trees: DataFrame) -> DataFrame:
    """Functions and classes per file that parses."""
    return trees.where(F.col("error").isNull()).select(
        *file_keys(trees),
        F.size(_of_kind("function")).alias("functions"),
        F.size(_of_kind("class")).alias("classes"),
    )


def complexity(node: Column) -> Column:
    return (node.weight_after - node.weight_before + 1).cast("int")


def function_length(node: Column) -> Column:
    return node.end_line - node.line


def python_functions(trees: DataFrame) -> DataFrame:
    """One row per function with its length, complexity and whether it has a docstring."""
    rows = trees.select(*file_keys(trees), F.explode_outer("nodes").alias("node"))
    node = F.col("node")
    return rows.where(node.kind == "function").select(
        *file_keys(trees), node["name"].alias("function"), node.line.alias("line"),
        node.walk_ord.alias("walk_ord"), complexity(node).alias("complexity"),
        function_length(node).alias("length"), node.documented.alias("documented"),
    )


def _hit(check, node, rule_ord, match_ord, *values) -> Column:
    """A finding about a node; ``values`` fill the places in the check's description."""
    description = F.format_string(check.description.replace("{}", "%s"), *values)
    return check_finding(
        check, type="quality", description=description, line=node.line,
        phase=LANGUAGE_PHASE, rule_ord=rule_ord, pos=node.walk_ord, match_ord=match_ord,
    )


def _node_findings(node: Column) -> Column:
    is_function = node.kind == "function"
    undocumented = _hit(
        catalog.MISSING_DOCSTRING, node, F.when(is_function, 1).otherwise(2), 0,
        F.when(is_function, "Function").otherwise("Class"), node["name"],
    )
    length = function_length(node)
    return F.concat(
        one_if(is_function & (complexity(node) > catalog.MAX_COMPLEXITY),
               _hit(catalog.HIGH_COMPLEXITY, node, 0, 0, node["name"], complexity(node))),
        one_if(is_function & (length > catalog.MAX_FUNCTION_LINES),
               _hit(catalog.LONG_FUNCTION, node, 0, 1, node["name"], length)),
        one_if(~node.documented, undocumented),
    )


def python_findings(trees: DataFrame) -> DataFrame:
    """Complexity, length and docstring findings per function or class; syntax errors per file."""
    error = check_finding(
        catalog.SYNTAX_ERROR, type="quality", line=F.col("error_line"),
        description=F.concat(F.lit(catalog.SYNTAX_ERROR.description.split("{}")[0]), F.col("error")),
        phase=LANGUAGE_PHASE, rule_ord=0, pos=0, match_ord=0,
    )
    found = F.when(F.col("error").isNotNull(), F.array(error)).otherwise(
        F.flatten(F.transform("nodes", _node_findings))
    )
    return explode_findings(trees.select(*file_keys(trees), found.alias("found")), F.col("found"))
