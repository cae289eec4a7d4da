"""python tests/llm/recall_jaccard.py [sf_dir]: the Jaccard join of a whole table against an exact join in plain Python.

Prints how many rows agree in set size and component. Not a part of the tests, as it takes some minutes on sf0.1.
"""

import re
import sys
import tempfile
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def exact(rows):
    """doc_id: (set size, least id of its component), by counting what sets share over an inverted index of all shingles."""
    sets, by_set = {}, defaultdict(list)
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
        if sets[i]:
            by_set[sets[i]].append(i)
    kinds = list(by_set)
    holders = defaultdict(list)
    for k, s in enumerate(kinds):
        for g in s:
            holders[g].append(k)
    root = list(range(len(kinds)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = 0
    for k, s in enumerate(kinds):
        common = Counter(o for g in s for o in holders[g] if o < k)
        for o, c in common.items():
            if 100 * c >= 80 * (len(s) + len(kinds[o]) - c):
                links += 1
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, s in enumerate(kinds):
        least[find(k)] = min([least.get(find(k), min(by_set[s])), *by_set[s]])
    of = {i: least[find(k)] for k, s in enumerate(kinds) for i in by_set[s]}
    return {i: (len(s), of.get(i, i)) for i, s in sets.items()}, len(kinds), links


def main() -> None:
    from pyspark.sql import SparkSession

    from spectraloom.llm.jaccard_join import op5_jaccard_join

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="recall-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    want, kinds, links = exact([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_jaccard_join(spark, sf).collect()}
    print(f"{sum(got[i] == w for i, w in want.items())} of {len(want)} rows agree; {kinds} distinct sets, {links} links between them")


if __name__ == "__main__":
    main()
