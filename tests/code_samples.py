"""Small source files of the four languages, written for these tests."""

SHOP_PY = '''"""Shop service.

def not_a_function(): inside a docstring
"""
from __future__ import annotations
import os, json as js
from shop.tax import add_tax, round_up as ru
from shop.models import (
    Order,  # the order
    Item,
)

LIMIT = 10


def open_shop(name: str,
              hours: int = 8) -> bool:
    """Open it.

unindented text in a docstring
    """
    if not name:
        raise ValueError("no name")
    return add_tax(hours) > ru(1.5)

# trailing comment


class Cart:
    """A cart."""

    def __init__(self):
        self.items = []

    @property
    def total(self):
        def inner(x):
            return x.price()
        return sum(inner(i) for i in self.items)

    async def send(self): return await self.client.post("/cart")


def last():
    print(os.path.join("a", "b"))
'''

TAX_PY = '''def add_tax(value):
    return value * 1.2


def round_up(value):
    return int(value) + 1
'''

TEST_PY = '''from shop.tax import add_tax, round_up


class TestTax:
    def test_add(self):
        assert add_tax(1) == 1.2


def test_round():
    value = round_up(1.5)
    assert value == 2


def helper():
    return round_up(2)
'''

WEB_JS = '''// Web helpers
import React, { useState as us, memo } from 'react';
import * as util from './util';
const fs = require('fs');

/* function hidden() {
} */
function render(node) {
  const text = `line {
  more ${node.name}`;
  return draw(node, "}");
}

export async function load(id) {
  const r = await fetch(`/x/${id}`);
  return r.json();
}

const twice = (x) => x * 2;

const handler = async (event) => {
  if (event.ok) {
    twice(event.size);
  }
  return new Map();
};

class Store extends Base {
  constructor(a) {
    super(a);
  }

  get size() {
    return this.count(1);
  }

  static from(list) {
    return list.map((x) => twice(x)).filter(Boolean);
  }
}
'''

MAIN_GO = '''package main

import "fmt"

import (
	"net/http"
	log "example.com/pkg/zlog"
)

type (
	ID   int
	Pair struct {
		A, B ID
	}
)

type Server struct {
	Port int
}

func NewServer(port int) *Server {
	return &Server{Port: port}
}

func (s *Server) Run() error {
	fmt.Printf("{%d", s.Port)
	go func() {
		s.log("x")
	}()
	return http.ListenAndServe(addr(s.Port), nil)
}

func main() {
	srv := NewServer(80)
	srv.Run()
}
'''

LIB_RS = '''use std::collections::HashMap;
pub use crate::model::{
    Shape,
    Size,
};

pub struct Point { x: f64, y: f64 }

pub(crate) enum Kind {
    A,
    B(u8),
}

pub trait Area {
    fn area(&self) -> f64;
}

impl Area for Point {
    fn area(&self) -> f64 {
        let m: HashMap<u8, u8> = HashMap::new();
        println!("{}", '{');
        helper(self.x).abs()
    }
}

async fn helper(v: f64) -> f64 {
    v
}
'''

FILES = {
    "shop/service.py": SHOP_PY,
    "shop/tax.py": TAX_PY,
    "tests/test_tax.py": TEST_PY,
    "web/app.js": WEB_JS,
    "cmd/main.go": MAIN_GO,
    "src/lib.rs": LIB_RS,
}
