"""Reading and writing: tables, lines, file trees and snapshots."""
