import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftgraph.operators.generate import Mock
from weftgraph.sources.terms import literal
from weftgraph.streaming.generate import generate_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counted(Mock):
    """Leaves a mark for each prompt in a folder."""

    def complete(self, prompts, outputs):
        import uuid

        for p in prompts:
            with open(f"{self.name}/{uuid.uuid4().hex}", "w") as f:
                f.write(p)
        return super().complete(prompts, outputs)


def test_each_prompt_is_asked_once(spark, tmp_path):
    import json

    for d in ("in", "asked"):
        (tmp_path / d).mkdir()
    schema = "id long, kind string"
    provider = Counted([("red", '["warm"]')], '["cold"]', name=str(tmp_path / "asked"))

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        terms = {"id": literal(F.col("id")), "kind": literal(F.col("kind"))}
        q = generate_stream(stream, terms, "How is {?kind}?", ["feel"], provider, str(tmp_path / "out"), str(tmp_path / "records"), str(tmp_path / "check"))
        q.awaitTermination(120)
        assert q.exception() is None

    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": i, "kind": k}) for i, k in enumerate(["red", "blue", "red"])))
    run()
    (tmp_path / "in/b.json").write_text("\n".join(json.dumps({"id": i, "kind": k}) for i, k in enumerate(["blue", "green"], 10)))
    run()
    out = spark.read.parquet(str(tmp_path / "out")).select("id.lex", "feel.lex").collect()
    assert sorted(map(tuple, out)) == [("0", "warm"), ("1", "cold"), ("10", "cold"), ("11", "cold"), ("2", "warm")]
    asked = sorted(f.read_text().splitlines()[0] for f in (tmp_path / "asked").iterdir())
    assert asked == ["How is blue?", "How is green?", "How is red?"]
