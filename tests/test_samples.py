from folioscan.plans import samples


def test_sample_folder_below_a_file_uri(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(samples.shared, "work_folder", lambda _: f"file://{tmp_path}/shared")
    state = samples.State(spark)
    assert state.root.startswith(f"{tmp_path}/shared/folioscan-sample-")
    assert sorted(r[0] for r in state.of("src_scan")) == sorted(samples.SEEN)
    assert ("first", "indexed", 14) in state.of("run_report")
