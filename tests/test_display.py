"""Chart data on literal rows: frame order, links, labels, series colour and opacity."""

from raceboard.plans import display

LB = ("year int, type string, id long, name string, constructor_name string, constructor_color string, "
      "wiki_url string, season_wiki_url string, metric_value double, position int")


def test_frames_and_links(spark):
    rows = [(2001, "Driver", 1, "A", "C", "#000000", "w1", "s2001", 5.0, 1),
            (2001, "Constructor", 9, "C", "C", "#000000", "w9", "s2001", 5.0, 1),
            (1999, "Driver", 2, "B", "C", "#000000", "w2", "s1999", 3.0, 1)]
    lb = spark.createDataFrame(rows, LB)
    frames = {(r.frame_label, r.type): r.frame_index for r in display.frames_seasons(lb).collect()}
    assert frames == {(1999, "Driver"): 1, (2001, "Driver"): 2, (2001, "Constructor"): 2}
    links = {r.year: (r.season_wiki_url, r.title) for r in
             display.frame_links(lb, "year", ["season_wiki_url"], display.chart_title("Points", True)).collect()}
    assert links[2001] == ("s2001", "Cumulative Points by Season and Driver/Constructor")
    axis = {r.type: r.axis_max for r in display.axis_ranges(lb).collect()}
    assert axis == {"Driver": 5.0, "Constructor": 5.0}


RACE = ("driver_name string, driver_code string, constructor_name string, constructor_color string, lap int, "
        "position int, ending_status string")


def test_labels_series_and_axis(spark):
    rows = [("D a", "AAA", "C1", "#2B4562", 0, 2, None), ("D a", "AAA", "C1", "#2B4562", 3, 1, "Finished"),
            ("D b", "BBB", "C2", None, 0, 1, None), ("D b", "BBB", "C2", None, 2, 2, "Engine")]
    race = spark.createDataFrame(rows, RACE)
    end = [(r.driver_code, r.position, r.bg_color, r.text_color, r.x) for r in display.end_labels(race).collect()]
    assert end == [("AAA", 1, "#2B4562", "#FFFFFF", 3 * 1.071), ("BBB", 2, "#BAB0AC", "#000000", 3 * 1.071)]
    start = [(r.driver_code, r.position, r.x) for r in display.start_labels(race).collect()]
    assert start == [("BBB", 1, 0.0), ("AAA", 2, 0.0)]
    series = {(r.driver_name, r.lap): (r.series_color, r.opacity) for r in display.driver_series(race, "D b").collect()}
    assert series[("D a", 3)] == ("#2B4562", 0.25) and series[("D b", 2)] == (None, 0.75)
    axis = display.bump_axis(race, display.bump_title(2021, "GP")).collect()[0]
    assert (axis.x_max, axis.y_max, axis.title) == (3 * 1.071, 2.2, "2021 GP Bump Chart")
