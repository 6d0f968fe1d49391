from loopweave.llm import leaks

ITEM = "Suppose a quiet operator drops edge 24, then CursorBroker delays what TurbineBroker left in its margin. Given 19 nodes on ring sable, SnapshotBroker may measure a verbose facade no later than step 43. Rank MeadowStore above CaravanClient if its limits exceeds 9.4 and the nightly run ended indirect."
OTHER = "Suppose a noisy operator drops edge 7, then LoomPanel rejects what RosterFactory left in its cursor. Given 5 nodes on ring linen, BatchLoader may attach a lazy import graph no later than step 3. Rank QuotaClient above MemberStore if its depth exceeds 2.5 and the dry run ended narrow."
SHARED = "Answer with the names of the modules only, separated by commas."


def run(spark, docs, items=((1, f"{SHARED}\n\n{ITEM}"), (2, f"{OTHER}\n\n{SHARED}"), (3, SHARED), (4, None), (5, ""))):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as _doc", "1 as item_id", "1 as share")
    i = spark.createDataFrame(list(items), "item_id bigint, text string").selectExpr("*", "'x' as suite", "1 as _id")
    return {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).where("kind = 'leak'").collect()}


def test_layouts_and_small_changes(spark):
    half = ITEM[: len(ITEM) // 2]
    docs = [
        (1, f"Intro. {ITEM} Outro."), (2, ITEM.upper()), (3, "> " + ITEM.replace(". ", ".\n> ")), (4, ITEM.replace(",", "").replace(".", " ")), (5, ITEM.replace(" a ", " the ").replace("then", "thus")), (6, half), (7, "X. " + ITEM.replace(". ", ".\n\nSomething else stands here now.\n\n")),
        (8, "".join(ch + "\u00ad" * (n % 7 == 0) for n, ch in enumerate(ITEM))), (9, " ".join(reversed(ITEM.split(". ")))),
    ]
    assert run(spark, docs) == {(i, 1) for i in range(1, 10)}


def test_what_is_no_leak(spark):
    docs = [(1, SHARED), (2, OTHER.replace("7", "9").replace("LoomPanel", "AnchorPanel").replace("RosterFactory", "HopperFactory").replace("noisy", "late")[:100]), (3, "The quiz only hints at \"Suppose a quiet operator drops edge 24\" and no more."), (4, None), (5, ""), (6, "unrelated " * 50)]
    assert run(spark, docs) == set()


def test_repeats_blocks_and_empty(spark):
    docs = [(1, ITEM), (1, ITEM), (2, ITEM + " " + OTHER)]
    assert run(spark, docs) == {(1, 1), (2, 1), (2, 2)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id bigint, text string")
    assert leaks.leaks(d, i, block=1).where("kind = 'leak'").count() == 3
    assert leaks.leaks(d.where("false"), i).count() == 0 and leaks.leaks(d, i.where("false")).count() == 0


def test_very_long_document(spark):
    assert run(spark, [(1, "filler words here " * 60_000 + ITEM)]) == {(1, 1)}


def test_ideographs(spark):
    item = "没有loom-store.ts的许可，CargoMapper和服务kelp都不得锁定字段cursor。假设PantryBroker持有40个句柄，而parcel-factory.ts在第28步只释放20个。"
    other = item.replace("CargoMapper", "LoomPanel").replace("loom", "menu").replace("40", "51").replace("cursor", "depth").replace("PantryBroker", "QuotaPanel").replace("parcel", "hopper").replace("28", "3").replace("20", "9").replace("kelp", "onyx")
    assert run(spark, [(1, item), (2, other)], ((1, item),)) == {(1, 1)}


def test_plain_words_and_short_items(spark):
    plain = "Every harbour keeps a lantern that nobody owns, and whoever passes the gate at dusk must carry it to the far end before the bell falls silent."
    stem = "Read the following story with care and tell which of the people in it may have spoken first and why."
    items = ((1, plain), (2, f"{stem} Old sailors rarely trust a calm morning."), (3, f"{stem} Young bakers often sing before dawn comes."), (4, "Quiet rivers hide deep stones"), (5, f"{plain[:20]} other words"))
    docs = [(1, f"Intro. {plain} Outro."), (2, f"We say: {plain[:75].upper()} and so on"), (3, f"Intro. {stem} Outro."), (4, "As they say, quiet rivers hide deep stones."), (5, "Quiet rivers hide many things, every harbour keeps a boat")]
    for block in (leaks.BLOCK, 1):
        d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i, block=block).where("kind = 'leak'").collect()} == {(1, 1), (2, 1), (4, 4)}


def test_other_values(spark):
    numbers = ITEM.replace("24", "31").replace("19", "12").replace("43", "8").replace("9.4", "6.1")
    both = numbers.replace("CursorBroker", "LoomPanel").replace("TurbineBroker", "QuotaClient").replace("SnapshotBroker", "MenuStore").replace("MeadowStore", "BatchLoader").replace("CaravanClient", "AnchorView")
    items = ((1, ITEM), (2, "Every harbour keeps a lantern that nobody owns, and whoever passes the gate at dusk must carry it home."), (3, "Rank LoomPanel above QuotaClient, MenuStore, BatchLoader and AnchorView."))
    docs = [(1, f"Intro. {both} Outro."), (2, f"Intro. {ITEM} Outro."), (3, "Every harbour keeps a boat. The lantern is new."), (4, both.upper())]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leaks.leaks(d, i).collect()}
    assert got == {(1, 1): "re-parameterised", (2, 1): "leak", (4, 1): "re-parameterised"}
