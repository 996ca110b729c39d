"""The XPath 2.0 language: errors, syntax trees and the parser."""
