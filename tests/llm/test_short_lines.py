"""Short lines and scripts without blanks."""

from tallyforge.llm import line_dedup


def test_short_and_unspaced_lines(spark):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(40))
    rows = [
        (1, f"Menu\n\nRead more here\n}}\n{han}\nred green blue white black grey"),
        (2, f"menu\n\nRead  more here\n}}\n{han}\nred green blue white black pink"),
        (3, f"Menus\n\nRead less here\n{{\n{han[:20]}x{han[21:]}\nred green blue white black"),
        (4, f"Other\n\nquite unlike\n{han[::-1]}\nred green white blue black gold"),
    ]
    gone = {r["doc_id"]: r["lines"] for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {2: [0, 2, 3, 4, 5], 3: [4, 5]}
