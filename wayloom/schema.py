"""Shapes of map tables, and the fixed values of the map format.

A map document is one nested row. ``wayloom.sources.json_map`` explodes it into tables keyed by
map_id, which the operators take and give:

rooms         map_id, area_id, area_name, area_ord, room_ord, id, x, y, z, env, weight, name, symbol, locked, ...
exits         map_id, src, key, dst, special, pos, weight, locked
labels, lines, env_colors, custom_colors, legs
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format. Its name, which documents bring in ``format``, is an argument of what checks it.
FORMAT_VERSION = 2
#: short name, number, opposite, x and y step
DIRECTIONS = [
    ("n", 1, "s", 0, 1),
    ("ne", 2, "sw", 1, 1),
    ("nw", 3, "se", -1, 1),
    ("e", 4, "w", 1, 0),
    ("w", 5, "e", -1, 0),
    ("s", 6, "n", 0, -1),
    ("se", 7, "nw", 1, -1),
    ("sw", 8, "ne", -1, -1),
    ("up", 9, "down", 0, 0),
    ("down", 10, "up", 0, 0),
    ("in", 11, "out", 0, 0),
    ("out", 12, "in", 0, 0),
]
DOORS = ["open", "closed", "locked"]
LINE_STYLES = ["solid", "dash", "dot", "dash_dot", "dash_dot_dot"]

ROOM = """struct<id:int,x:int,y:int,z:int,env:int,name:string,symbol:string,notes:string,hash:string,weight:int,locked:boolean,
hidden:boolean,exits:map<string,int>,stubs:array<string>,exit_locks:array<string>,doors:map<string,string>,exit_weights:map<string,double>,
special_exits:map<string,int>,special_exit_locks:array<string>,tags:array<string>,user_data:map<string,string>,
custom_lines:map<string,struct<points:array<array<double>>,color:array<int>,style:string,arrow:boolean>>>"""
LABEL = """struct<id:int,x:double,y:double,z:int,width:double,height:double,text:string,fg_color:array<int>,bg_color:array<int>,
no_scaling:boolean,show_on_top:boolean,pixmap:string>"""
LINE = "struct<name:string,board:array<string>,exit:string,legs:array<struct<`from`:int,`to`:int,time:double,label:string>>>"
MAP = f"""format string, format_version int,
meta struct<map_name:string,symbol_font:struct<family:string,point_size:double,pixel_size:double,style_hint:int,weight:int,style_setting:boolean,underline:boolean,strike_out:boolean,fixed_pitch:boolean>,symbol_font_fudge_factor:double,use_only_map_font:boolean,room_id_hash:map<string,int>,user_data:map<string,string>>,
colors struct<env_colors:map<string,int>,custom_env_colors:map<string,array<int>>>,
areas array<struct<id:int,name:string,grid_mode:boolean,is_zone:boolean,zone_area_ref:int,pos:array<int>,user_data:map<string,string>,rooms:array<{ROOM}>,labels:array<{LABEL}>>>,
checksums struct<alg:string,file:string,meta:string,areas:map<string,string>,rooms:map<string,string>,transports:struct<hash:string,lines:map<string,string>>>,
transports struct<format:string,version:int,lines:array<{LINE}>>""".replace("\n", "")


def lookup(key: Column, pairs: dict) -> Column:
    """A value for key from a fixed table; null for others."""
    out = F.lit(None)
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def direction_number(key: Column) -> Column:
    return lookup(key, {d[0]: d[1] for d in DIRECTIONS}).cast("int")


def opposite(key: Column) -> Column:
    return lookup(key, {d[0]: d[2] for d in DIRECTIONS}).cast("string")
