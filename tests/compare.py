import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    found = duck.sql(sql)
    names = sorted(found.columns)
    places = [found.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)
