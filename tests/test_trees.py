from codelattice.operators import hierarchy as H
from tests.conftest import rows


def tree(frame):
    return H.path_tree(frame("id string, label string, file_path string, line int", [
        ("m1", "UserService.save", "src/main/java/app/UserService.java", 4), ("m2", "UserService.load", "src/main/java/app/UserService.java", 9),
        ("m3", "Repo.get", "src/main/java/db/Repo.java", 1), ("m4", "top", "README.java", 1), ("m5", "none", "", 1)]))


def test_tree_rows(frame):
    got = {r.id: (r.parent_id, r.name, r.type) for r in tree(frame).collect()}
    assert got["dir:src"] == ("", "src", "directory")
    assert got["dir:src/main/java/app"] == ("dir:src/main/java", "app", "directory")
    assert got["file:src/main/java/db/Repo.java"] == ("dir:src/main/java/db", "Repo.java", "file")
    assert got["file:README.java"][0] == "" and got["m2"][0] == "file:src/main/java/app/UserService.java"
    assert "m5" not in got and len(got) == 5 + 3 + 4


def test_chains_merge(frame):
    assert rows(H.compact_chains(tree(frame)), "id", "name", "parent_id") == [
        ("dir:src/main/java", "src/main/java", ""), ("dir:src/main/java/app", "app", "dir:src/main/java"), ("dir:src/main/java/db", "db", "dir:src/main/java")]


def test_search_shows_hits_ancestors_and_what_is_below_a_lone_hit(frame):
    assert "m2" in [r.id for r in H.search_tree(tree(frame), "app").collect()]
    hit = {r.id for r in H.search_tree(tree(frame), "SAVE").collect()}
    assert hit == {"m1", "file:src/main/java/app/UserService.java", "dir:src", "dir:src/main", "dir:src/main/java", "dir:src/main/java/app"}
    assert H.search_tree(tree(frame), "nothing").count() == 0
    assert H.search_tree(tree(frame), "").count() == 12


def test_children_order(frame):
    ordered = [r.id for r in H.tree_sorted(tree(frame)).where("parent_id = ''").collect()]
    assert ordered == ["dir:src", "file:README.java"]
