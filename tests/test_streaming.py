from graphloom.streaming import degrees


def test_degrees_follow_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run() -> dict:
        q = degrees.stream_degrees(degrees.stream_triples(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {r["id"]: (r["out_degree"], r["in_degree"]) for r in spark.table("degrees").collect()}

    (folder / "a.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\nbad\n<http://e/a> <http://e/p> <http://e/b> .\n")
    assert run() == {"http://e/a": (2, 0), "http://e/b": (0, 2)}
    (folder / "b.nt").write_text("<http://e/b> <http://e/p> <http://e/a> .\n")
    assert run() == {"http://e/a": (2, 1), "http://e/b": (1, 2)}
