"""A small code corpus of our own, put beside the driver's tables so that code analyzers have something to find."""

SAMPLES = {
    "app/store.rs": '''use crate::model::Item;
use serde::Serialize;
use super::util::*;

/// Holds items.
pub struct Store {
    items: Vec<Item>,
    log: String,
    pub(crate) count: usize,
}

impl Store {
    pub fn add(&mut self, item: Item) {
        self.items.push(item);
        self.count = self.count + 1;
    }
    pub fn note(&mut self, text: &str) {
        self.log.push_str(text);
    }
    pub fn size(&self) -> usize {
        if self.count > 10 && self.items.len() >= 3 {
            return self.count;
        }
        self.items.len()
    }
}

// TODO: bound the list
#[allow(dead_code)]
fn helper(data: &[u8], name: &str) -> usize {
    let _ = parse(data);
    let secret_value = name.to_string();
    println!("{}", secret_value);
    match data.len() {
        0 => 0,
        1 => load(name),
        _ => data.iter().map(|b| *b as usize).sum(),
    }
}

fn load(path: &str) -> usize {
    std::fs::read_to_string(path).unwrap().len() // FIXME(ann) handle this */
}

fn parse(data: &[u8]) -> usize { data.len() }

#[cfg(test)]
mod tests {
    #[test]
    fn sizes() { super::load("x").unwrap(); }
}
''',
    "app/query.rs": '''use crate::store::Store;

pub fn find(db: &Db, user: &str) -> Rows {
    db.execute(&format!("SELECT * FROM t WHERE u = '{}'", user)).expect("query")
}

pub fn hash(password: &str) -> String {
    let digest = Md5::digest(password);
    todo!()
}
''',
    "tool/job.py": '''import os
import hashlib
from typing import List, Dict
from m import unused_name


def run(items: List[str], depth=0):
    """Runs."""
    total = 0
    for i in items:
        if i and depth < 3:
            total += len(i)
        elif depth > 5:
            total -= 1
    return total


async def later(x):
    password = "hunter2 is long enough"
    print(password)
    try:
        return hashlib.md5(x).hexdigest()
    except Exception:
        pass


def plain(a, b): return a == b or True
# HACK: "TODO inside" kept
x = eval("1 + 1")
label = "TODO: in a string"
requests.get(u, verify=False)
api_key = "q8Zr5TnW2vXb7LkM4pJd"
''',
    "tool/test_job.py": '''from hypothesis import given


def test_run():
    assert True


@given(st.text())
def test_text(s):
    assert run([s]) >= 0
''',
    "web/page.js": '''import { render, mount as m } from "./view";
import Missing from "lib";
const fs = require("fs");

/**
 * @param {string} name
 */
function greet(name) {
  document.write(name);
  return name === "a" ? 1 : 2;
}

function bare(buffer, list) {
  fetch(list).catch(() => {});
  try {
    render(buffer);
  } catch (e) {
  }
}
const token = Math.random();
console.log(token);
if (false) {
}
else
{}
// XXX odd
''',
    "web/api.ts": '''export class Api {
  public get(path: string): string {
    return path;
  }
}
function typed(a: number): void {
}
function untyped(a) {
  return a;
}
''',
    "srv/main.go": '''package main

import (
	"fmt"
	"log"
)

// Load reads.
func Load(path string, raw []byte) error {
	_ = raw
	if err != nil {
	}
	authToken := path
	log.Printf("x %s", authToken)
	for i := 0; i < 3; i++ {
		fmt.Println(i)
	}
	return nil
}

func TestLoad(t *testing.T) {}
''',
    "lib/Main.java": '''import java.util.List;

/** Entry. */
public class Main {
    // WARN: weak
    public static void main(String[] args) {
        MessageDigest.getInstance("MD5");
        for (String a : args) {
            if (a.isEmpty()) { continue; }
        }
    }
}
''',
    "empty.py": "",
    "blank.rs": "\n\n",
}

_quote = lambda s: "'" + s.replace("'", "''") + "'"
VALUES = ", ".join(f"({_quote(f)}, {_quote(s)})" for f, s in SAMPLES.items())
