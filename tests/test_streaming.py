from voxloom.streaming import manifests


def test_new_files_run_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def go(name, text):
        (folder / name).write_text(text)
        query = manifests.watch(spark, str(folder), "img_path string, steps int", lambda row: f"out/{row['img_path']}/{10 // row['steps']}", str(tmp_path / "out"), str(tmp_path / "check"), once=True)
        query.awaitTermination(60)
        return sorted((r.img_path, r.output_folder, r.error) for r in spark.read.schema("img_path string, steps int, output_folder string, error string").json(str(tmp_path / "out")).collect())

    first = [("a", "out/a/5", None), ("b", None, "ZeroDivisionError: integer division or modulo by zero")]
    assert go("1.csv", "img_path,steps\na,2\nb,0\n") == first
    assert go("2.csv", "img_path,steps\nc,5\n") == [*first, ("c", "out/c/2", None)]
