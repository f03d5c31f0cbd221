import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SAMPLE = {
    "src/calc.py": '''import math

class Calculator:
    def add(self, a, b):
        return a + b

    def area(self, r):
        logger.info("area")
        return math.pow(r, 2)

def build():
    c = Calculator()
    return c
''',
    "tests/test_calc.py": '''from calc import build

def test_build_ok():
    c = build()
    assert c.add(1, 2) == 3
''',
}

BOX = '''package a.b;
import java.util.List;
public class Box {
  private int size;
  public Box(int size) { this.size = size; }
  public void put(Item item) { log.info("x"); store.add(item); }
}
'''


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomgraph.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Build ``file_path, content`` rows from a dict of texts."""

    def build(texts):
        rows = [(path, bytearray(text.encode())) for path, text in texts.items()]
        return spark.createDataFrame(rows, "file_path string, content binary")

    return build
