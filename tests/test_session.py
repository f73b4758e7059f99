"""Work folders lie together under the application's own and go when they are released."""

import os

from ledgerlark import session
from ledgerlark.operators.common import stored


def test_the_folder_of_an_application(spark):
    own = f"ledgerlark-{spark.sparkContext.applicationId}"
    path = session.work_dir(spark, "x")
    assert os.path.basename(os.path.dirname(path)) == own and os.path.basename(path).startswith("x-") and path != session.work_dir(spark, "x")
    if base := spark.conf.get("spark.checkpoint.dir", None):
        assert path.startswith(os.path.join(base, own))


def test_release_removes_the_work_of_the_application(spark, tmp_path, monkeypatch):
    own = f"ledgerlark-{spark.sparkContext.applicationId}"
    monkeypatch.setattr(session, "_base", lambda s: str(tmp_path / own))
    assert stored(spark.range(10), "numbers").count() == 10 and os.listdir(tmp_path) == [own]
    (tmp_path / "ledgerlark-other").mkdir()
    before = session.releases
    for n in (1, 2):  # nothing left is no fault
        session.release(spark)
        assert os.listdir(tmp_path) == ["ledgerlark-other"] and session.releases == before + n
    assert stored(spark.range(3), "again").count() == 3
