"""The folder source against plain walks of real trees."""

import os
import random

import pytest

from kindred.sources import listing
from kindred.sources.files import EXTENSIONS


def names(frame):
    return sorted(r.filename for r in frame.collect())


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / ".trash").mkdir()
    (tmp_path / "none").mkdir()
    for name in ("photo1.jpg", "photo2.PNG", "readme.txt", ".hidden.jpg", ".jpg", "_under.gif", "sub/photo3.jpeg", "sub/deep/a b#%é.heic", "sub/.dots.bmp", ".trash/gone.jpg"):
        (tmp_path / name).write_bytes(b"abc")
    (tmp_path / "sub/empty.webp").write_bytes(b"")
    return tmp_path


ALL = [".dots.bmp", ".hidden.jpg", "_under.gif", "a b#%é.heic", "empty.webp", "photo1.jpg", "photo2.PNG", "photo3.jpeg"]


@pytest.mark.parametrize("spread", [1, 2, 3, 64])
def test_photo_listing_has_hidden_empty_and_underscored_files(spark, tree, spread):
    assert names(listing.photo_files(spark, [(str(tree), True)], spread=spread)) == ALL
    assert names(listing.photo_files(spark, [(str(tree), False)], spread=spread)) == [".hidden.jpg", "_under.gif", "photo1.jpg", "photo2.PNG"]


def test_several_missing_and_empty_folders(spark, tree):
    some = [(str(tree / "sub"), False), (str(tree / "missing"), True), (str(tree / "none"), True), (str(tree / "sub" / "deep"), True)]
    assert names(listing.photo_files(spark, some)) == [".dots.bmp", "a b#%é.heic", "empty.webp", "photo3.jpeg"]
    assert names(listing.photo_files(spark, [])) == []
    twice = names(listing.photo_files(spark, [(str(tree / "sub"), True), (str(tree / "sub" / "deep"), True)]))
    assert twice.count("a b#%é.heic") == 2


def test_columns_of_a_file(spark, tree):
    row = listing.photo_files(spark, [(str(tree), False)]).where("filename = 'photo2.PNG'").first()
    assert (row.path, row.dir, row.ext, row.size) == (str(tree / "photo2.PNG"), str(tree), ".png", 3)
    assert abs(row.modified.timestamp() - (tree / "photo2.PNG").stat().st_mtime) < 86_400


def test_rename_listing_leaves_out_hidden_names_and_links_and_fails_on_missing_folders(spark, tree):
    os.symlink(tree / "photo1.jpg", tree / "linked.jpg")
    os.symlink(tree / "sub", tree / "other")
    assert names(listing.rename_files(spark, str(tree), True)) == ["_under.gif", "a b#%é.heic", "empty.webp", "photo1.jpg", "photo2.PNG", "photo3.jpeg"]
    with pytest.raises(Exception, match="No such file"):
        listing.rename_files(spark, str(tree / "missing"), True).count()
    with pytest.raises(Exception, match="Not a directory"):
        listing.rename_files(spark, str(tree / "photo1.jpg"), True).count()


@pytest.mark.parametrize("spread", [1, 64])
def test_links_are_followed_once_and_reasons_are_rows(spark, tree, spread):
    os.symlink(tree / "sub" / "deep", tree / "again")
    os.symlink(tree, tree / "sub" / "back")
    os.symlink("self.jpg", tree / "self.jpg")
    os.symlink("nowhere.jpg", tree / "broken.jpg")
    folders = [(str(tree), True), (str(tree / "missing"), True)]
    listed = listing.listing(spark, folders, spread=spread)
    assert names(listed.where("reason is null")) == sorted([*ALL, "a b#%é.heic"])
    reasons = {os.path.relpath(r.path, tree): r.reason for r in listing.skipped_files(listed).collect()}
    assert reasons == {"broken.jpg": "No such file or directory", "self.jpg": "Too many levels of symbolic links", "sub/back": "link to a folder it is in", "missing": "No such file or directory", "sub/empty.webp": "empty"}


def test_a_random_tree_and_a_directory_of_very_many_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PEEK", 30)
    draw, folders = random.Random(4), [tmp_path]
    for k in range(60):
        folders.append(draw.choice(folders) / f"d{k}")
        folders[-1].mkdir()
    for k in range(800):
        (draw.choice(folders[:20]) / f"f{k}{draw.choice([*EXTENSIONS, '.txt', ''])}").write_bytes(b"x" * draw.randint(0, 2))
    expected = sorted(f for _, _, fs in os.walk(tmp_path) for f in fs if os.path.splitext(f)[1] in EXTENSIONS)
    for spread in (1, 5, 64):
        reader = listing.FolderReader({"folders": f'[["{tmp_path}", true]]', "spread": str(spread)})
        units = reader.partitions()
        assert spread == 1 or any(u.parts > 1 for u in units)
        rows = [r for u in units for b in reader.read(u) for r in b.column("filename").to_pylist()]
        assert sorted(rows) == expected
    assert names(listing.photo_files(spark, [(str(tmp_path), True)])) == expected
