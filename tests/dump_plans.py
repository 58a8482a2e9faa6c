"""Write PLANS.md: the physical operator tree of the headline queries.

python -m tests.dump_plans [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import sys

sys.path.insert(0, ".")

import __spark_entry__ as entry  # noqa: E402
from kerbside.plans import registry  # noqa: E402
from bench import HEADLINE  # noqa: E402
from kerbside.session import build_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0].strip()  # the operator tree, before the node details


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    qs = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}
    out = [
        "# Physical plans of the headline queries",
        "",
        f"`explain(\"formatted\")` operator trees at `{sf_dir.rsplit('/', 1)[-1]}`, before AQE re-planning",
        "(`AdaptiveSparkPlan isFinalPlan=false`). Staged inputs (`kerbside-stage/...`) are Parquet",
        "written by the ordering step or NEAR1 rounds while the plan was built. Regenerate with",
        "`python -m tests.dump_plans`.",
        "",
        "At this size Catalyst broadcasts join sides that are small by file-size statistics (even the",
        "numbered jobs). At scale the same joins plan as sort-merge joins, where AQE splits skewed",
        "partitions. The only intentional broadcasts are the per-partition offsets (≤ partition count)",
        "and fixed lists.",
        "",
    ]
    for name in HEADLINE:
        out += [f"## {name}", "", "```", tree(qs[name](spark, sf_dir)), "```", ""]
    spark.stop()
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
