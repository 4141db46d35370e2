import pytest

#: Tiny tables: compiling each plan would take most of the time.
SMALL = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "3"}


@pytest.fixture(autouse=True)
def small_plans(request):
    if "spark" not in request.fixturenames:
        yield
        return
    spark = request.getfixturevalue("spark")
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
