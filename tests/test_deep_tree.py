from quirelake.operators.objects import objects
from quirelake.operators.pages import pages


def test_pages_below_64_levels(spark):
    depth = 70
    nodes = ["1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj"]
    nodes += [f"{k} 0 obj << /Type /Pages {'/Rotate 90 ' if k == 2 else ''}/Kids [{k + 1} 0 R{' 999 0 R' if k == 2 else ' 2 0 R'}] >> endobj" for k in range(2, depth + 2)]
    nodes += [f"{depth + 2} 0 obj << /Type /Page >> endobj", "999 0 obj << /Type /Page /Rotate 0 >> endobj"]
    file = spark.createDataFrame([("a", "\n".join(nodes).encode())], "file_id string, content binary")
    found = {r.object_id: (r.page_number, r.rotation) for r in pages(objects(file)).collect()}
    assert found == {f"obj:{depth + 2}:0": (1, 90), "obj:999:0": (2, 0)}
