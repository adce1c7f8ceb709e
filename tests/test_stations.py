"""A tree of station files whose headers differ, with one that can't be read."""

from meltemi.sources import stations


def test_each_file_by_its_own_header(spark, tmp_path):
    for y in (2001, 2002):
        (tmp_path / str(y)).mkdir()
    (tmp_path / "2001" / "a.csv").write_text('STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TEMP,DEWP,PRCP\n"a","2001-01-02","37.1","25.2","10","A, X","50.0","41.0","1.00"\n')
    (tmp_path / "2001" / "b.csv").write_text('"DATE","STATION","PRCP","LONGITUDE","LATITUDE"\n"2001-01-03","b","0.50","25.0","38.0"\n"2001-01-04","b","99.99","25.0","38.0"\n')
    (tmp_path / "2002" / "c.csv").write_text("STATION,DATE,LATITUDE\nc,2002-01-01,38\n")
    (tmp_path / "2002" / "d.csv.gz").write_bytes(b"\x1f\x8b\x08\x00 not a gzip stream")
    rows = sorted((r.station_id, str(r.date), r.lat, r.lon, r.name, r.tmean_c, r.prcp_mm) for r in stations.read_stations(spark, str(tmp_path), 2000, 2003).collect())
    assert rows == [("a", "2001-01-02", 37.1, 25.2, "A, X", 10.0, 25.4), ("b", "2001-01-03", 38.0, 25.0, None, None, 12.7), ("b", "2001-01-04", 38.0, 25.0, None, None, None)]
